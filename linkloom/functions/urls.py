"""Links in text, as Column expressions: everything stays in the JVM.

Each rule is one regular expression built from the word lists. A dot in running text is decided by the words beside
it, in the order of the rules: a dot before a top-level domain joins, one after a top-level domain or before a common
word ends a sentence, one after a common word stays, any other joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import lexicon as lex

QUOTES = "\"'`“”‘’«»′″"
SCHEME = r"(?i)^(?:https?|ftp)://"
#: Groups that repeat are possessive throughout: Java keeps a frame of the stack for each turn of any other, and a text may have thousands of labels in one token.
LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\."
#: Labels that no last label can begin at, as two letters do not.
SHORT = rf"(?:(?![a-z]{{2}}){LABEL})*+"
#: A host goes on to the last place where one can end: a label is taken while there is such a place after it.
HOST = rf"{LABEL}(?:{SHORT}(?=[a-z]{{2}}){LABEL}(?={SHORT}[a-z]{{2}}))*+{SHORT}[a-z]{{2,}}"
ADDRESS = rf"(?iU)(?:https?|ftp)://[^\s<>\[\]()\"']+|(?<![@\w./-]){HOST}(?::\d{{2,5}})?(?:/[^\s<>\[\]()\"']*)?"
#: What ends an address, and runs of other characters that may hold one: with a letter after a dot, or a scheme's end.
EDGE = r"\s<>\[\]()\"'"
TOKEN = rf"(?U)(?<![^{EDGE}])(?=[^{EDGE}]*?(?:\.\w|://))[^{EDGE}]++"
IPV4 = r"^\d{1,3}(?:\.\d{1,3}){3}"
BLANKS = " \t\n\x0b\f\r"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def among(value: Column, words) -> Column:
    """Whether a value is one of many words: as one pattern, which is planned faster than a list of literals."""
    return value.rlike(rf"\A{lex.one_of(words)}\z")


def _dots(text: Column, tlds: tuple[str, ...]) -> Column:
    """Text with each dot decided by the labels on both sides of it, in one pass: cut at the dots, so the cost of the word lists goes with the number of dots.

    Blanks around a dot that joins go, those around one that ends a sentence become one behind it.
    """
    tld, word, after = lex.one_of(lex.top_level_domains(tlds)), lex.one_of(lex.TEXT_WORDS), "(?![A-Za-z0-9])"
    begins = lambda x, pattern: x.rlike(rf"(?i)\A{pattern}{after}")
    equals = lambda x, pattern: x.rlike(rf"(?i)\A{pattern}\z")
    stay, join, end = F.lit(0), F.lit(1), F.lit(2)

    def decided(x: Column) -> Column:
        near = x["label"].rlike(r"[A-Za-z0-9]\z") & x["head"].rlike(r"\A[A-Za-z0-9]")
        rules = F.when(begins(x["head"], tld), join).when(equals(x["label"], tld), end).when(begins(x["head"], word), end).when(equals(x["label"], word), stay).otherwise(join)
        return F.when(near, rules).otherwise(stay)

    def all_of(parts: Column) -> Column:
        # no label of the lists is longer than what is looked at
        label = lambda p: F.regexp_extract(F.right(p, F.lit(120)), r"([A-Za-z0-9-]*)\s{0,50}\z", 1)
        head = lambda p: F.substr(F.ltrim(p, F.lit(BLANKS)), F.lit(1), F.lit(70))
        between = lambda p, i: let(F.struct(label(p).alias("label"), head(F.get(parts, i + 1)).alias("head")), decided)
        return F.struct(parts.alias("parts"), F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), between).alias("how"))

    def put(x: Column) -> Column:
        how = lambda i: F.coalesce(F.get(x["how"], i), stay)
        left = lambda p, i: F.when(how(i - 1) == stay, p).otherwise(F.ltrim(p, F.lit(BLANKS)))
        both = lambda p, i: F.when(how(i) == stay, left(p, i)).otherwise(F.rtrim(left(p, i), F.lit(BLANKS)))
        return F.array_join(F.transform(x["parts"], lambda p, i: F.concat(both(p, i), F.when(how(i) == end, ". ").when(i < F.size(x["parts"]) - 1, ".").otherwise(""))), "")

    return let(F.split(text, "\\.", -1), lambda parts: F.when(F.size(parts) > 1, let(all_of(parts), put)).otherwise(F.get(parts, 0)))


def sanitize(text: Column, tlds: tuple[str, ...] = ()) -> Column:
    """Text without quotes, and without the blanks that split a link at dots, slashes or after the scheme."""
    # what a text does not hold costs it one quick look
    where = lambda mark, f: lambda t: F.when(t.rlike(mark), f(t)).otherwise(t)
    quotes = where("['’‘`]", lambda t: F.regexp_replace(t, r"(?<=[A-Za-z0-9])\s*['’‘`]+\s*(?=[A-Za-z0-9])", ""))
    scheme = where("/", lambda t: F.regexp_replace(t, r"(?i)\b(https?|ftp|upi)\s*:\s*/\s*/\s*", "$1://"))
    slash = where("/", lambda t: F.regexp_replace(t, r"(?<=[A-Za-z0-9.])\s*/\s*(?=[A-Za-z0-9])", "/"))
    out = let(text, quotes)
    out = let(F.translate(out, QUOTES, ""), scheme)
    return let(_dots(F.regexp_replace(out, r"(?i)\b(www)\s*\.\s*", "www."), tlds), slash)


def clean(url: Column, tlds: tuple[str, ...] = ()) -> Column:
    """A link without the punctuation, numbers and words of a sentence that stick to its end; the rules repeat until nothing changes."""
    tld, tail, exts = lex.one_of(lex.top_level_domains(tlds)), lex.one_of(lex.TAIL_WORDS), lex.one_of(lex.FILE_EXTS)
    titled = rf"(?!(?i:{tld})$)[A-Z][a-z]*"
    camel = "(?:" + "|".join(f"{w[0].upper()}(?i:{w[1:]})" for w in lex.TAIL_WORDS if len(w) > 2) + ")"
    spoken = rf"(?:(?i:{lex.one_of(lex.TEXT_WORDS)})|(?!(?i:{tld})/?$)[A-Z][A-Za-z0-9-]*)"
    pairs = lex.one_of(lex.MULTI_PART_TLDS)
    scheme, label, ends = r"(?:(?:https?|ftp)://)?+", "[^./?#:]++", rf"{tld}(?:[.:?#]|$)"
    other, word = rf"\.(?!{ends}){label}", rf"(?<!(?=\.){pairs})\.(?!{exts}$){tail}(?=$|[:?#/])(?<!\.{pairs})"

    def once(u: Column) -> Column:
        # a port that is no number goes, and a query before the path comes after it
        u = F.regexp_replace(u, r"(?i)^(?!(?:mailto|javascript|tel|upi):)((?:(?:https?|ftp)://)?+[^/?#:]+):(?!\d+(?:[/?#]|$))[^/?#]*", "$1")
        u = F.regexp_replace(u, r"(?i)^((?:(?:https?|ftp)://)?+[^/?#]*)(\?[^/]*|#[^/?]*)(/.*)$", "$1$3$2")
        u = F.regexp_replace(u, r"^((?:[^?#.,]++|(?:[.,]\d++%?)++(?!$)|[.,](?!\d))*+)(?:[.,]\d++%?)++$", "$1")
        u = F.regexp_replace(u, r"[.,;:!?)\]}>\"']+$", "")
        u = F.regexp_replace(u, rf"\.+/{spoken}/?$", "")
        # hosts without a path: labels after the last top-level domain go, then words after one
        u = F.regexp_replace(u, rf"(?i)^({scheme}{label}\.{label}(?:(?:{other})*+\.(?={ends}){label})*+)(?:{other})++(?=$|[:?#][^/]*$)", "$1")
        u = F.regexp_replace(u, rf"(?i)^({scheme}(?:{label}\.(?!{tld}{word}))*+{label}\.{tld}){word}", "$1")
        u = F.regexp_replace(u, rf"(/[a-z0-9][a-z0-9-]*){camel}(?=$|[?#])", "$1")
        u = F.regexp_replace(u, rf"\.(?!(?i:{exts})$)(?:(?i:{tail})|{titled})$", "")
        return F.regexp_replace(u, r"(?i)^(?!(?:https?|ftp)://)([^/]+)/$", "$1")

    head = lambda u: F.regexp_extract(F.trim(sanitize(u, tlds)), r"^\S+", 0)
    # a round that changes a link takes off a letter at least (or, once, writes www. small), so this ends when nothing changes
    rounds = lambda u: F.sequence(F.lit(0), F.char_length(u) + 1)
    state = lambda u, done: F.struct(u.alias("url"), done.alias("done"))
    again = lambda x: let(once(head(x["url"])), lambda v: state(v, v == x["url"]))
    return let(head(url), lambda u: F.aggregate(rounds(u), state(u, F.lit(False)), lambda x, _: F.when(x["done"], x).otherwise(again(x)), lambda x: x["url"]))


def host_of(url: Column) -> Column:
    """Host of a link without scheme, user, port and outer dots, as it is written."""
    bare = F.regexp_replace(F.trim(url), SCHEME, "")
    host = F.substring_index(F.substring_index(bare, "/", 1), "@", -1)
    return F.btrim(F.substring_index(host, ":", 1), F.lit(". "))


def path_of(url: Column) -> Column:
    """What follows the host's slash, without query and fragment."""
    bare = F.regexp_replace(F.trim(url), SCHEME, "")
    rest = F.when(F.contains(bare, F.lit("/")), F.regexp_replace(bare, "^[^/]*/", "")).otherwise("")
    return F.regexp_replace(rest, r"(?s)[?#].*", "")


def tld_of(host: Column, tlds: tuple[str, ...] = ()) -> Column:
    """The host's top-level domain, with both labels of a two-part one; null if there is none."""
    known = lex.top_level_domains(tlds)

    def of(labels: Column) -> Column:
        last = F.try_element_at(labels, F.lit(-1))
        two = F.concat_ws(".", F.try_element_at(labels, F.lit(-2)), last)
        return F.when((F.size(labels) >= 3) & among(two, lex.MULTI_PART_TLDS), two).when((F.size(labels) >= 2) & among(last, known), last)

    return let(F.filter(F.split(F.lower(F.btrim(host, F.lit("."))), r"\."), lambda x: x != ""), of)


def _noise(x: Column) -> Column:
    """Whether a link is a piece of a sentence, from x: url, host (in lower case), tld and name of its host without www., and left, the labels before them."""
    www, name, tld = x["host"].startswith("www."), x["name"], x["tld"]
    short = lambda x: (F.char_length(x) <= 2) & x.rlike(r"^[a-z]+$")
    has_path = F.btrim(path_of(x["url"]), F.lit("/")) != ""
    fragment = among(name, lex.SENTENCE_WORDS) | among(tld, lex.SENTENCE_WORDS) | short(name)
    country = ~x["url"].rlike(SCHEME) & (F.char_length(tld) == 2) & name.rlike(r"^[a-z]+$")
    loose = F.forall(x["left"], lambda x: among(x, lex.TEXT_WORDS) | short(x))
    return (
        F.when(x["host"] == "", True).when(x["host"].rlike(IPV4 + "$"), False).when(tld.isNull(), True).when(among(name, lex.FUNCTION_WORDS), True)
        .when(www | has_path | among(tld, lex.TRUSTED_TLDS), False).when(country, True).otherwise(fragment & loose)
    )


def is_noise(url: Column, tlds: tuple[str, ...] = ()) -> Column:
    """Whether a link is a piece of a sentence that only looks like a domain."""

    def named(x: Column) -> Column:
        labels = F.filter(F.split(x["rest"], r"\."), lambda x: x != "")
        parts = F.size(F.split(x["tld"], r"\."))
        left = F.slice(labels, F.lit(1), F.greatest(F.lit(0), F.size(labels) - parts - 1))
        return F.struct(x["url"].alias("url"), x["host"].alias("host"), x["tld"].alias("tld"), F.try_element_at(labels, -parts - 1).alias("name"), left.alias("left"))

    placed = lambda h: let(F.regexp_replace(h["host"], r"^www\.", ""), lambda r: F.struct(h["url"].alias("url"), h["host"].alias("host"), r.alias("rest"), tld_of(r, tlds).alias("tld")))
    return let(F.struct(url.alias("url"), F.lower(host_of(url)).alias("host")), lambda h: let(placed(h), lambda x: let(named(x), _noise)))


def looks_like_url(url: Column, tlds: tuple[str, ...] = ()) -> Column:
    """Whether a cleaned link is one: its length, its scheme, a known top-level domain, and no noise."""

    def judged(x: Column) -> Column:
        u, host, tld = x["url"], x["host"], x["tld"]
        shouted = host.rlike(r"^[A-Z][a-z]*\.[A-Z]{3,}$") | host.rlike(r"(?:^|\.)[A-Z][a-z]*$")
        bare = ~among(tld, lex.SOURCE_ENDINGS) & ~among(tld, lex.AMBIGUOUS_TLDS)
        kind = F.when(u.rlike(SCHEME), "schemed").when(shouted, "shouted").when(F.lower(u).startswith("www."), "www").otherwise("bare")
        # one test for noise serves all kinds
        sound = tld.isNotNull() & ~is_noise(u, tlds)
        return let(kind, lambda k: ((k == "schemed") & host.rlike(IPV4)) | ((k != "shouted") & ((k != "bare") | bare) & sound))

    def placed(u: Column) -> Column:
        first = F.substring_index(F.regexp_replace(u, SCHEME, ""), "/", 1)
        return let(F.substring_index(first, ":", 1), lambda h: F.struct(u.alias("url"), h.alias("host"), tld_of(h, tlds).alias("tld")))

    sane = lambda u: F.char_length(u).between(4, 250) & ~u.rlike(r"(?i)^(?:mailto|javascript|tel):")
    return F.coalesce(let(url, lambda u: F.when(sane(u), let(placed(u), judged))), F.lit(False))


def clean_link(url: Column, tlds: tuple[str, ...] = ()) -> Column:
    """The cleaned link; null if it is none."""
    return let(clean(url, tlds), lambda u: F.when(looks_like_url(u, tlds), u))


def _lengths(pieces: Column, n: Column) -> Column:
    return F.aggregate(F.slice(pieces, F.lit(1), n), F.lit(0), lambda s, x: s + F.char_length(x))


def _judged(token: Column, tlds: tuple[str, ...]) -> Column:
    """The links of a token: array<struct<url, match, i>>, i counting all that have the form of an address."""

    def good(x: Column) -> Column:
        return looks_like_url(x["url"], tlds) & ~F.coalesce(F.substr(x["match"], F.char_length(x["url"]) + 1).rlike(r"^/[A-Za-z0-9]"), F.lit(False))

    # cleaning only takes off, so what has neither a scheme nor a whole label that is a top-level domain stays none; most sentences end here
    last = lex.one_of({t.rpartition(".")[2] for t in (*lex.top_level_domains(tlds), *lex.MULTI_PART_TLDS)})
    possible = lambda x: F.contains(x["match"], F.lit("://")) | x["match"].rlike(rf"(?iU)\.{last}(?![a-z0-9-])")
    numbered = F.transform(F.regexp_extract_all(token, F.lit(ADDRESS), 0), lambda m, i: F.struct(m.alias("match"), i.alias("i")))
    cleaned = F.transform(F.filter(numbered, possible), lambda x: F.struct(clean(x["match"], tlds).alias("url"), x["match"].alias("match"), x["i"].alias("i")))
    return F.filter(cleaned, good)


def extract_urls(text: Column, tlds: tuple[str, ...] = ()) -> Column:
    """array<struct<url, start>>: the links of a text in order; start is a place in the sanitised text.

    Matches do not overlap. A bare host that is only the head of a longer address is not counted, and neither is the
    host of an e-mail address. No address crosses the edge of a token, so addresses are looked for in tokens with a dot.
    """

    def placed(both: Column) -> Column:
        before = lambda k: _lengths(both["gaps"], k + 1) + _lengths(both["tokens"], k)

        def inside(token: Column, k: Column) -> Column:
            gaps, found = F.split(token, ADDRESS, -1), F.regexp_extract_all(token, F.lit(ADDRESS), 0)
            start = lambda i: before(k) + _lengths(gaps, i + 1) + _lengths(found, i)
            return F.transform(_judged(token, tlds), lambda x: F.struct(x["url"].alias("url"), start(x["i"]).alias("start")))

        return F.flatten(F.transform(both["tokens"], inside))

    return let(sanitize(text, tlds), lambda t: let(F.struct(F.regexp_extract_all(t, F.lit(TOKEN), 0).alias("tokens"), F.split(t, TOKEN, -1).alias("gaps")), placed))


def urls_in(text: Column, tlds: tuple[str, ...] = ()) -> Column:
    """The links of a text in order, without their places; null for a text that cannot hold any."""
    tokens = lambda t: F.regexp_extract_all(sanitize(t, tlds), F.lit(TOKEN), 0)
    urls = lambda token: F.transform(_judged(token, tlds), lambda x: x["url"])
    return let(text, lambda t: F.when(may_hold_url(t), F.flatten(F.transform(tokens(t), urls))))


def may_hold_url(text: Column) -> Column:
    """A cheap test to put before extract_urls: letters after a dot with a letter or digit before it."""
    return text.rlike(r"[A-Za-z0-9]\s*\.\s*[A-Za-z]{2}|://")


def extract_urls_anyhow(text: Column, tlds: tuple[str, ...] = ()) -> Column:
    """Links of recognised text: of the whole; failing that, line by line; failing that, of pieces of 8 letters or more."""
    urls = lambda t: F.coalesce(urls_in(t, tlds), F.array().cast("array<string>"))
    by = lambda pattern, least: F.flatten(F.transform(F.filter(F.split(text, pattern), lambda x: F.char_length(F.trim(x)) >= least), urls))
    # all three are made beside each other: mentioned twice or one inside the other, the long link rules take far longer to plan
    tried = F.array(urls(text), by(r"\R", 1), by(r"[\s|;]+", 8))
    return let(tried, lambda t: F.coalesce(F.get(F.filter(t, lambda x: F.size(x) > 0), 0), F.get(t, 2)))


def repair_ocr(text: Column) -> Column:
    """Misread ends of hosts put right: .corn becomes .com, and so on."""
    for right in dict.fromkeys(lex.OCR_TLD_FIX.values()):
        wrong = lex.one_of(k for k, v in lex.OCR_TLD_FIX.items() if v == right)
        text = F.regexp_replace(text, rf"(?i)\.{wrong}\b", f".{right}")
    return text


def one_confusable(a: Column, b: Column) -> Column:
    """Whether two strings of one length differ in exactly one place, by letters that are mistaken for each other."""
    pairs = [p for x in lex.CONFUSABLE_PAIRS for p in (x, x[::-1])]
    both = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, F.concat(x, y))), lambda p: p.isNotNull())
    return (F.char_length(a) == F.char_length(b)) & (F.size(both) == 1) & F.try_element_at(both, F.lit(1)).isin(*pairs)


def snap_host(host: Column, printed: Column, known: dict[str, str] | None = None) -> Column:
    """The first printed host that differs by one confusable letter; failing that, known misreadings; else the host."""
    near = F.try_element_at(F.filter(printed, lambda p: one_confusable(F.lower(host), F.lower(p))), F.lit(1))
    other = host
    for wrong, right in (known or {}).items():
        other = F.regexp_replace(other, rf"(?i)\b{wrong}(?=\.(?:com|net|org)\b)", right)
    return F.coalesce(near, other)


def payload_rank(payload: Column) -> Column:
    """Better payloads rank higher: with a scheme, with a dot, longer."""
    return F.struct(payload.rlike(r"(?i)^[a-z][a-z0-9+.-]*://").alias("scheme"), F.contains(payload, F.lit(".")).alias("dot"), F.char_length(payload).alias("length"))


def compact_length(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def safe_name(name: Column) -> Column:
    """A file name for storage: odd characters become one underscore each run."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("._")), F.lit("")), F.lit("file.pdf"))


def strip_default_port(url: Column) -> Column:
    """https links without :443 and http links without :80; the host is lower-cased where a port goes."""
    pattern = r"^(?:(https://)([^/?#]*):443|(http://)([^/?#]*):80)(?=[/?#]|$)"
    part = lambda u, *ks: F.concat(*(F.regexp_extract(u, pattern, k) for k in ks))
    return let(url, lambda u: F.when(u.rlike(pattern), F.concat(part(u, 1, 3), F.lower(part(u, 2, 4)), F.regexp_replace(u, pattern, ""))).otherwise(u))


def normalize(url: Column) -> Column:
    """The form that is probed: white space and quotes gone, https:// where there is no scheme; null for mail and scripts."""
    u = F.regexp_replace(F.translate(url, QUOTES + "\u200b\u200c\u200d\ufeff\u00a0", ""), r"\s+", "")
    u = F.regexp_replace(u, r"[.,;:!?)\]}>]+$", "")
    schemed = lambda u: F.when(u.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    return let(u, lambda u: F.when((u == "") | u.rlike(r"(?i)^(?:mailto|javascript|tel):"), None).when(u.rlike("(?i)^upi://"), u).otherwise(strip_default_port(schemed(u))))


def candidates(url: Column) -> Column:
    """Addresses to try in order: as it is, the other scheme, then both with www. where the host has none."""

    def every(u: Column) -> Column:
        secure, web = u.startswith("https://"), F.regexp_replace(F.regexp_replace(u, r"[;#].*$", ""), r"(?i)^[a-z]+://", "://www.")
        other = F.when(secure, F.regexp_replace(u, "^https://", "http://")).when(u.startswith("http://"), F.regexp_replace(u, "^http://", "https://"))
        lacks = ~F.lower(host_of(u)).startswith("www.") & u.rlike("(?i)^https?://")
        one, two = F.when(secure, "https").otherwise("http"), F.when(secure, "http").otherwise("https")
        return F.array(u, other, F.when(lacks, F.concat(one, web)), F.when(lacks, F.concat(two, web)))

    return F.array_distinct(F.transform(F.array_compact(let(url, every)), strip_default_port))


def link_key(url: Column) -> Column:
    """What makes two links the same."""
    return F.lower(F.trim(url))
