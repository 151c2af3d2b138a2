"""Word lists that the link rules need, and the regular expressions made of them."""

from __future__ import annotations

from importlib import resources

# Results depend on these words being exactly so.
MULTI_PART_TLDS = """
ac.uk co.uk gov.uk ac.jp co.jp or.jp ne.jp com.au net.au org.au edu.au gov.au co.nz org.nz co.in net.in org.in gov.in
ac.in res.in co.za org.za gov.za com.br org.br gov.br com.mx org.mx com.cn net.cn org.cn gov.cn com.hk com.sg com.tw
co.kr co.id com.ar com.tr com.ua com.pl
""".split()
AMBIGUOUS_TLDS = "al am an as at be by do et go he hi id ie if in is it me my no ok on or pm re so st th to up us vs we".split()
FUNCTION_WORDS = "a al an and as at by et for from if in is it no of on or our so the this that to us we with your".split()
SENTENCE_WORDS = """
about above account accounts additional address after all also any apply available before below between both but call
can card cards click contact customer customers details during each email every find following further get go have
here how important including information into its just learn link login mail make more most note now online only open
other out over page please policy privacy questions read rewards see service services should site some step such take
terms than then there these through under use using view visit was website were what when where which who why will you
""".split()
TAIL_EXTRA = "amount balance bill due order payment rupee rupees steps today total".split()
TRUSTED_TLDS = "com org net edu gov mil int io ai biz co app dev xyz one bank".split()
FILE_EXTS = "asp aspx csv css gif htm html jpeg jpg js json pdf php png svg txt webp xml zip".split()
SOURCE_ENDINGS = "py java c h json xml csv txt log".split()
FORM_STOP = """
PDF FAX TEL TAX USA THE AND FOR WWW COM NET ORG INC LLC LTD BOX PAY DUE APR MAY JUN JUL AUG SEP OCT NOV DEC JAN FEB
MAR SUN MON TUE WED THU FRI SAT SYF URL IMG PNG JPG EOF ALL NOT YES TBD ETA GST EIN SSN DOB ZIP APT STE AVE QR PMT ACH
ABA PO
""".split()
OCR_TLD_FIX = {
    "corn": "com", "corm": "com", "coom": "com", "comm": "com", "c0m": "com", "con": "com", "ccm": "com", "oom": "com", "coml": "com", "cm": "com",
    "0rg": "org", "ogr": "org", "orgg": "org", "n3t": "net", "nett": "net",
}
CONFUSABLE_PAIRS = ("fl", "il", "1l", "1i", "0o", "ce", "5s", "8b", "6g", "2z")

#: The top-level domains that are taken for such, one a line; callers can add to them.
TLDS = frozenset(resources.files(__package__).joinpath("tlds.txt").read_text("ascii").split())

TAIL_WORDS = sorted({*SENTENCE_WORDS, *FUNCTION_WORDS, *TAIL_EXTRA})
TEXT_WORDS = sorted({*SENTENCE_WORDS, *FUNCTION_WORDS})


def top_level_domains(extra: tuple[str, ...] = ()) -> tuple[str, ...]:
    """TLDS and the caller's own."""
    return tuple(sorted({*TLDS, *(x.lower() for x in extra)}))


def one_of(words) -> str:
    """A group that matches any of the words, the longest first."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}
    return _branches(tree)


def _branches(node: dict) -> str:
    """The words of a tree of letters. As they share their beginnings, a place that holds none fails at its first letters."""
    ways = []
    for letter in sorted(k for k in node if k):
        tail, below = letter.replace(".", r"\."), node[letter]
        while len(below) == 1 and "" not in below:
            ((letter, below),) = below.items()
            tail += letter.replace(".", r"\.")
        ways.append(tail + (_branches(below) if any(below) else ""))
    return "(?:" + "|".join(ways) + ")" + ("?" if "" in node else "")
