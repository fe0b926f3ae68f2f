"""Text and URL functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that only track, those of affiliate links with their paths and networks, and suffixes of two labels.
TRACKING_PREFIXES = [
    "utm_", "pk_", "mtm_", "matomo_", "hsa_", "vero_", "wt_",
]
TRACKING_PARAMS = [
    "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "twclid", "igshid", "ttclid", "mc_cid", "mc_eid", "yclid", "_hsenc", "_hsmi", "oly_anon_id",
    "oly_enc_id", "source", "campaign", "medium", "spm", "scm", "from", "share_source", "ref", "referrer", "referral", "aff", "affiliate",
    "affiliate_id", "partner", "tag", "sub_id", "subid", "clickid", "irclickid", "sscid", "cjevent", "at_medium", "at_campaign", "CMP", "ncid",
    "sr_share", "guccounter",
]
AFFILIATE_PARAMS = [
    "ref", "aff", "affiliate", "affiliate_id", "partner", "partnerid", "tag", "irclickid", "sscid", "clickid", "cjevent", "sub_id",
]
AFFILIATE_PATHS = ["/go/", "/out/", "/recommends/", "/aff/", "/deal/", "/r/"]
AFFILIATE_HOSTS = r"(?i)(^|\.)(shareasale|impact|awin|cj|clickbank|linksynergy|partnerize)\."
TWO_LEVEL = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "or.jp", "ne.jp", "ac.jp", "com.cn", "net.cn", "org.cn", "gov.cn", "com.au", "net.au", "org.au",
    "com.br", "com.mx", "co.in", "co.nz", "co.za", "com.tr",
]
#: A parameter is compared in lower case, so the one written in capitals never fits.
TRACKING = "^(" + "|".join([f"{x}.*" for x in TRACKING_PREFIXES] + TRACKING_PARAMS) + ")$"
CJK = "[぀-ゟ゠-ヿ㐀-䶿一-鿿豈-﫿가-힯]"


def compare_form(text: Column) -> Column:
    """Lower case, with what is no letter or digit as single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts and styles go, block ends become blanks, tags go, the common entities are decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tokens(text: Column, longer_than: int = 0) -> Column:
    return F.array_distinct(F.filter(F.split(compare_form(text), " "), lambda w: F.length(w) > longer_than))


def title_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the tokens longer than two characters; 0 where neither has one."""
    x, y = tokens(a, 2), tokens(b, 2)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the words, each padded by two blanks before and one behind."""
    padded = F.transform(F.filter(F.split(compare_form(text), " "), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def registrable(url: Column) -> Column:
    return F.substring_index(host(url), ".", -2)


def canonical_url(url: Column) -> Column:
    """https, no www, default port, fragment or trailing slash; AMP and print variants are the page itself; tracking parameters go and the
    others are sorted. Null for what is no web address."""
    raw = F.trim(url)
    port = F.regexp_extract(raw, r"^[a-zA-Z]+://[^/:?#]+(:\d+)", 1)
    path = F.regexp_extract(raw, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    for pattern, new in ((r"(?i)/amp/?$", "/"), (r"(?i)\.amp(\.html?)?$", "$1"), (r"(?i)/print/?$", "/"), ("//+", "/"), ("/$", "")):
        path = F.regexp_replace(path, pattern, new)
    params = F.split(F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(params, lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).rlike(TRACKING))), "&")
    out = F.concat(F.lit("https://"), host(raw), F.when(port.isin(":80", ":443"), "").otherwise(port), path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(raw.rlike(r"(?i)^https?://[^/:?#]"), out)


def registrable_domain(name: Column) -> Column:
    """The part of a host that somebody registers: two labels, three below a suffix of two."""
    bare = F.regexp_replace(F.lower(name), r"^www\.", "")
    return F.when(F.substring_index(bare, ".", -2).isin(TWO_LEVEL), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def affiliate(raw_url: Column) -> Column:
    """Whether a web address, as it was written, pays whoever wrote it: by a parameter, the start of its path or its host."""
    names = F.transform(F.split(F.regexp_extract(raw_url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: F.split(p, "=")[0])
    path = F.lower(F.regexp_extract(raw_url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1))
    begins = path.rlike("^(" + "|".join(AFFILIATE_PATHS) + ")")
    return F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, AFFILIATE_PARAMS))) | begins | host(raw_url).rlike(AFFILIATE_HOSTS), F.lit(False))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize(text: Column) -> Column:
    """Compatibility forms of the characters, none of zero width, blanks as single ones. ASCII texts skip the Python step's work but not its trip."""
    return F.trim(F.regexp_replace(F.regexp_replace(_nfkc(text), "[\u200B-\u200D\uFEFF]", ""), r"(?U)\s+", " "))


def is_cjk(text: Column) -> Column:
    """Whether more than 15 % of the characters are CJK."""
    return F.coalesce(F.regexp_count(text, F.lit(CJK)) > 0.15 * F.length(text), F.lit(False))


def word_count(text: Column) -> Column:
    """Words of the comparable form; characters without blanks where the text is CJK. CJK is written without blanks, so one beside it is left of punctuation and no character of the text."""
    form = compare_form(text)
    written = F.regexp_replace(form, f" (?={CJK})|(?<={CJK}) ", "")
    return F.when(is_cjk(written), F.length(F.regexp_replace(form, r"\s+", ""))).when(form == "", 0).otherwise(F.size(F.split(form, " ")))


def runs(units: Column, size: int, between: str) -> Column:
    """Neighbouring units joined, with repeats; fewer units than `size` are one run, none nothing."""
    n = F.size(units)
    each = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.array_join(F.slice(units, i, F.lit(size)), between))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(units, " "))).otherwise(each)


def held(value: Column, use) -> Column:
    """`use` of a value that is reckoned once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def features(text: Column) -> Column:
    """What a text is about, with repeats for weight: its words twice and its word pairs once; the character pairs of a CJK text."""
    letters = lambda form: F.filter(F.split(F.regexp_replace(form, r"\s+", ""), ""), lambda c: c != "")
    words = lambda form: F.filter(F.split(form, " "), lambda w: w != "")
    weighed = lambda form: held(words(form), lambda w: F.concat(w, w, runs(w, 2, " ")))
    return held(compare_form(text), lambda form: F.when(is_cjk(form), held(letters(form), lambda c: runs(c, 2, ""))).otherwise(weighed(form)))


def first_words(text: Column, n: int) -> Column:
    """The first words of the comparable form. A text is only taken apart up to the word after them, on which the small form of a last letter may depend."""
    head = F.regexp_extract(text, rf"^[^\p{{L}}\p{{N}}]*+(?:[\p{{L}}\p{{N}}]++[^\p{{L}}\p{{N}}]++){{0,{n}}}+[\p{{L}}\p{{N}}]*+", 0)
    return F.array_join(F.slice(F.split(compare_form(head), " "), 1, n), " ")


def fnv1a64(text: Column) -> Column:
    """FNV-1a over the low bytes of the characters, as a signed 64-bit number.

    The hash is kept as two halves of 32 bits, since longs that overflow are errors: times 2^40 + 0x1b3 is a shift and a small product.
    """
    low = F.lit((1 << 32) - 1)
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h, c):
        lo = h["lo"].bitwiseXOR(F.ascii(c).cast("long").bitwiseAND(F.lit(255)))
        product = lo * 0x1B3
        hi = (h["hi"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(lo, 8)).bitwiseAND(low)
        return F.struct(hi.alias("hi"), product.bitwiseAND(low).alias("lo"))

    whole = lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"])
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, whole)


def content_hash(title: Column, body: Column) -> Column:
    """SHA-256 of the comparable forms of title and body."""
    form = lambda x: compare_form(F.coalesce(x, F.lit("")))
    return F.sha2(F.concat_ws("\n", form(title), form(body)), 256)


def without_urls(text: Column) -> Column:
    """The text with blanks for addresses and bare domains, so that neither names anything."""
    bare = F.regexp_replace(text, r"(?i)https?://\S+", " ")
    return F.regexp_replace(bare, r"(?i)[\w-]+\.(com|org|io|dev|net|ai|co|cloud|sh|app)", " ")


def summary(text: Column, most: int = 400) -> Column:
    """At most `most` characters: up to the last sentence end if that is past 60 % of them, else cut with an ellipsis."""
    cut = F.substring(text, 1, most)
    end = F.length(F.regexp_extract(cut, r"(?s)^(.*[.!?])", 1))
    return F.when(F.length(text) <= most, text).when(end > most * 0.6, F.substring(cut, F.lit(1), end)).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def shingles(text: Column, size: int = 3) -> Column:
    """Runs of `size` words of the comparable form, in order and with repeats; a shorter text is one shingle, an empty one none."""
    words = F.filter(F.split(compare_form(text), " "), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) < size, F.array(F.array_join(words, " "))).otherwise(runs)


def slug(name: Column) -> Column:
    """Lower case and hyphens, without a trailing version; letters beyond ASCII become hyphens unless they have a plain form in the table."""
    plain = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    unversioned = F.regexp_replace(plain, r"\s+v?\d+(\.\d+)*([-.][a-z0-9]+)*\s*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(unversioned, "['’]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normal_term(raw: Column) -> Column:
    """The key that two spellings of a name share."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(raw), r"[\s_]+", "-"), "[^a-z0-9.+#-]", ""), "^-+|-+$", "")


#: Shapes of words that may be the name of a product.
NAME_SHAPES = [r"^[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*$", r"(?i)^[A-Za-z][A-Za-z0-9-]*\.(js|ts|io|sh|dev|ai|rs|py|go)$", "^[A-Za-z][A-Za-z0-9-]*(DB|QL|SQL|Kit|Lang|Script|Stack|Hub|Flow)$", r"^[a-z]\d[a-z]{1,4}$"]


def candidate_terms(title: Column, common: list[str]) -> Column:
    """Distinct words of a title that look like product names and are not among the `common` ones."""
    words = F.split(F.regexp_replace(title, r"https?://\S+", " "), r"[\s,;:!?()\[\]{}\"'“”‘’|]+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, "^[^A-Za-z0-9]+|[^A-Za-z0-9.+#]+$", ""))
    named = lambda w: F.length(w).between(3, 28) & ~F.lower(w).isin(common) & ~w.rlike(r"(?i)^v?\d") & w.rlike("|".join(f"(?:{s})" for s in NAME_SHAPES))
    return F.array_distinct(F.filter(bare, named))


def repo_variants(owner: Column, repo: Column) -> Column:
    """Names that a repository may go by: itself, its owner, without common endings one after another, with blanks or nothing for its hyphens."""
    base, out = repo, [repo, owner]
    # Endings that say what kind of repository it is.
    for ending in ("-?(server|core|src|lang|js|cli|sdk|api|app|io|oss|community|main|monorepo)$", "-?(spec|specification|standard|proposal|rfc)$", r"\d+$"):
        shorter = F.regexp_replace(base, ending, "")
        base = F.when(shorter == "", base).otherwise(shorter)
        out.append(base)
    out += [F.regexp_replace(repo, "[-_]", " "), F.regexp_replace(repo, "[-_]", ""), F.concat_ws("/", owner, repo)]
    return F.filter(F.array_distinct(F.array(*out)), lambda x: F.length(x) >= 2)


def pretty_repo(repo: Column) -> Column:
    """A repository's name as words, each with a capital."""
    parts = F.filter(F.split(repo, "[-_]"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), " ")


def github_repo(url: Column) -> Column:
    """owner/name of an address on GitHub, else null."""
    found = F.regexp_extract(url, r"^(?i:https?://(?:www\.)?github\.com)/+([^/?#]+/+[^/?#]+)", 1)
    return F.when(found != "", F.regexp_replace(F.regexp_replace(found, "/+", "/"), r"\.git$", ""))


def url_key(url: Column) -> Column:
    """Host and path in lower case, without www, .git and slashes at the end; null for what is no address."""
    path = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), r"\.git$", ""), "/+$", ""))
    return F.when(url.rlike(r"^[a-zA-Z]+://[^/?#]"), F.concat(host(url), path))


# Words that carry no identity, and what separates words of a name.
NO_IDENTITY = [
    "the", "a", "an", "of", "and", "for", "to", "me", "my",
]
NAME_BORDERS = "[()\\[\\]{}.,:;!?\"'’/\\-]+"


def title_fits(name: Column, title: Column) -> Column:
    """Whether the title has every word of the name that carries identity; a name without one fits nothing."""
    words = lambda x: F.filter(F.split(F.regexp_replace(F.lower(x), NAME_BORDERS, " "), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(NO_IDENTITY))
    return (F.size(words(name)) > 0) & (F.size(F.array_except(words(name), words(title))) == 0)


def confirmation(repo: Column, site: Column, repos: Column, sites: Column, of_type: Column, name: Column, title: Column) -> Column:
    """What confirms a candidate entry: its repository, its website, or its type together with its name; null if nothing does."""
    among = lambda one, many: F.coalesce(F.exists(many, lambda x: url_key(x) == url_key(one)), F.lit(False))
    return F.when(among(repo, repos), "repo").when(among(site, sites), "website").when(of_type & title_fits(name, title), "typed")


def release_title(title: Column, source: Column) -> Column:
    """A title that is a bare tag, with the project before it, which is the source's name without `releases` or `tags`."""
    tag, project = F.trim(title), F.trim(F.regexp_replace(source, r"(?i)\s+(releases|tags)$", ""))
    bare = tag.rlike(r"^\S+$") & (project != "") & ~F.contains(F.lower(tag), F.lower(project))
    return F.when(bare, F.concat_ws(" ", project, tag)).otherwise(title)


# What marks a release that nobody should read as news.
PRERELEASE_TITLE = [
    r"(?i)(^|[-\s.])(rc|alpha|beta|preview|pre|nightly|snapshot|canary)\d*($|[-\s.])", r"(?i)(^|[-\s.])dev\d*($|[-\s.])", r"(?i)^\s*(b|build[-\s]?)\d{3,}\s*$", r"(?i)\d+\.\d+[\d.]*-b\d+",
    r"(?i)(^|[-\s/])(viable|strict|ci|main|master|head|untagged)[-\s/]", r"(^|[-\s/])\d{9,}($|[-\s/])", r"(?i)(^|[-\s.])(dirty|wip|test|debug|unstable|edge)($|[-\s.])",
]


def prerelease_title(title: Column) -> Column:
    return F.coalesce(F.trim(title).rlike("|".join(f"(?:{p})" for p in PRERELEASE_TITLE)), F.lit(False))


# Sentences that a page has around its content, and what such text begins with.
CHROME = [
    "you must be signed in", "there was an error while loading", "please reload this page", "enable javascript", "javascript is disabled", "accept all cookies", "sign in to continue", "are you a robot",
    "access denied", "change notification settings", "notifications you must be", "fork your own copy", "this repository was archived by the owner", "folders and files", "latest commit history",
    "open more actions menu", "branchestags",
]
CHROME_PREFIXES = [
    "uh oh!?", r"there was an error while loading\.?", r"please reload this page\.?", r"this repository was archived by the owner on [^.]+\.", r"it is now read-only\.?",
    r"[\w.-]+\s*/\s*[\w.-]+\s+public(\s+archive)?", r"forked from\s+[\w.-]+/[\w.-]+", "notifications?", r"you must be signed in to change notification settings\.?",
    r"fork your own copy of [\w.-]+/[\w.-]+", r"(star|fork|watch)\s+[\d.,km]+",
]


def looks_like_chrome(text: Column, first: int = 600) -> Column:
    """Whether the beginning of a text is a page's furniture."""
    head = F.lower(F.substring(text, 1, first))
    return F.coalesce(F.exists(F.array(*map(F.lit, CHROME)), lambda m: F.contains(head, m)), F.lit(False))


def strip_chrome(text: Column) -> Column:
    """The text without furniture at its front, however many pieces follow one another: one pattern takes them all."""
    return F.trim(F.regexp_replace(text, r"(?i)^(?:\s*(?:" + "|".join(CHROME_PREFIXES) + r")\s*)+", ""))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight(text: Column, asked: str) -> Column:
    """The text as HTML, with marks around the words asked for that are longer than two letters."""
    words = dict.fromkeys(w for w in re.split(r"\s+", re.sub("[\"'-]", " ", asked.lower())) if len(w) > 2)
    escaped = escape_html(text)
    return F.regexp_replace(escaped, "(?i)(" + "|".join(map(re.escape, words)) + ")", "<mark>$1</mark>") if words else escaped


def resolved_slug(asked: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """The rows with `slug` from (alias, slug): by the name as it is, without what stands in parentheses and hyphens for dots and blanks, or without hyphens, the first that hits."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    bare = F.regexp_replace(F.regexp_replace(plain(F.col(name)), r"\s*\(.*\)$", ""), r"[.\s_]+", "-")
    forms = F.array_distinct(F.array(plain(F.col(name)), bare, F.replace(bare, F.lit("-"), F.lit(""))))
    known = aliases.select(plain(F.col("alias")).alias("_form"), "slug").groupBy("_form").agg(F.min("slug").alias("_slug"))
    tried = asked.select(name).distinct().select(name, F.posexplode(forms).alias("_no", "_form")).join(known, "_form")
    best = tried.groupBy(F.col(name).alias("_name")).agg(F.min_by("_slug", "_no").alias("slug"))
    return asked.join(best, F.col(name) == F.col("_name"), "left").drop("_name")
