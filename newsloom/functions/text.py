"""Text, URL, title and date semantics as Column expressions: the one place where regular expressions are pinned down.

Survey items F1 to F12, F16, F20 to F23, F36, P6, P7. All expressions stay inside the JVM; a null argument is an empty
string unless said otherwise.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in titles, and query parameters that only track.
TITLE_STOPWORDS = (
    "a", "against", "and", "announces", "announce", "in", "introduces", "launch", "launches", "legally", "new", "news", "of", "on",
    "operate", "operating", "permit", "permits", "powers", "rollout", "secures", "the", "to", "with",
)
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid")

#: Word boundaries that Java and RE2 both understand, for letters and digits of any script.
OPEN, CLOSE = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fold(c) -> Column:
    """Case folding as far as it differs from lower case in the languages at hand."""
    return F.replace(F.lower(text(c)), F.lit("ß"), F.lit("ss"))


def clean(c) -> Column:
    """White space collapsed and trimmed (F1)."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def blob(*parts) -> Column:
    """The parts that are not empty, with a blank between."""
    return F.concat_ws(" ", *[F.nullif(text(p), F.lit("")) for p in parts])


def domain(url) -> Column:
    """Authority of a URL, folded, without ``www.`` (F2)."""
    return F.replace(fold(F.regexp_extract(text(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)), F.lit("www."), F.lit(""))


def source_or_domain(source, url) -> Column:
    return F.coalesce(F.nullif(clean(source), F.lit("")), domain(url))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url) -> Column:
    """Lower-case scheme and authority, no ``www.``, path parameters, fragment or tracking, sorted query."""
    u = F.trim(text(url))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^(?://[^/?]*)?([^?]*)", 1), r";[^/]*$", "")
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_extract(p, "=(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda x: ~fold(x.k).isin(*TRACKING_PARAMS)))
    flat = F.array_join(F.transform(kept, lambda x: F.concat(_encoded(x.k), F.lit("="), _encoded(x.v))), "&")
    authority = domain(u)
    # a URL without authority keeps none: scheme:path, as the generic syntax has it
    out = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit(":"), F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(
        F.when(path.startswith("//"), "//").otherwise("")), path, F.when(flat != "", F.concat(F.lit("?"), flat)).otherwise(""))
    return F.when(u == "", "").otherwise(out)


def title_key(title) -> Column:
    """Key of a title for duplicate tests."""
    v = F.replace(F.replace(fold(title), F.lit("’"), F.lit("'")), F.lit("`"), F.lit("'"))
    for pattern, new in (
        (r"\bwef\b", "world economic forum"), (r"\s*\|\s*[^|]{2,80}$", ""), (r"\s+-\s+[^-]{2,80}$", ""), (r"\s*-\s*", "-"),
        (r"\b(\d+)\s*\.\s*(\d+)x\b", "$1.$2x"), (r"[^a-z0-9#%.]+", " "), (r"\s+", " "),
    ):
        v = F.regexp_replace(v, pattern, new)
    return F.trim(v)


_TIME = r"(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,6})?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?"


def published_date(value) -> Column:
    """Date of an ISO 8601 or RFC 2822 GMT text, else null (F6). The weekday of an RFC date is not checked."""
    v = text(value)
    rfc = F.try_to_timestamp(F.regexp_extract(v, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})?) GMT", 1), F.lit("d MMM yyyy HH:mm:ss"))
    iso = F.when(v.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}{_TIME}$"), F.substring(v, 1, 10).try_cast("date"))
    basic = F.when(v.rlike(rf"^\d{{8}}{_TIME}$"), F.try_to_timestamp(F.substring(v, 1, 8), F.lit("yyyyMMdd")).cast("date"))
    return F.when(v.contains(",") & v.contains("GMT"), rfc.cast("date")).otherwise(F.coalesce(iso, basic))


def any_date(value) -> Column:
    """The first thing in a text that looks like a date, else its ISO reading."""
    return F.coalesce(F.regexp_extract(text(value), r"\d{4}-\d{2}-\d{2}", 0).try_cast("date"), published_date(value))


def title_tokens(key: Column) -> Column:
    """Distinct meaningful tokens of a title key."""
    long = F.filter(F.split(key, " "), lambda t: (F.char_length(t) >= 3) & ~t.isin(*TITLE_STOPWORDS))
    return F.array_distinct(F.transform(long, lambda t: F.when(t.endswith("s") & (F.char_length(t) > 4), F.regexp_replace(t, "s$", "")).otherwise(t)))


def contained(left: Column, right: Column) -> Column:
    """Both have five words or more and the one with fewer stands in the other."""
    nl, nr = F.size(F.split(left, " ")), F.size(F.split(right, " "))
    return (F.least(nl, nr) >= 5) & F.when(nl <= nr, F.contains(right, left)).otherwise(F.contains(left, right))


def semantic(left_tokens: Column, right_tokens: Column) -> Column:
    """The token sets overlap enough."""
    both = F.size(F.array_intersect(left_tokens, right_tokens))
    short = F.least(F.size(left_tokens), F.size(right_tokens))
    near = both / F.greatest(short, F.lit(1))
    share = both / F.greatest(F.size(F.array_union(left_tokens, right_tokens)), F.lit(1))
    return (short >= 3) & (((both >= 3) & (near >= 0.85)) | ((both >= 4) & ((near >= 0.6) | (share >= 0.45))))


def quoted(term: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\/#&~-])", r"\\\1", term)


def term_pattern(term: str, inflect: bool = False) -> str:
    """Bounded pattern of a folded term; single plain words may take an ending, blanks match any white space."""
    term = term.casefold().strip()
    if inflect and re.fullmatch("[a-z]+", term):
        return f"{OPEN}{term}(s|es|ed|ing)?{CLOSE}"
    return OPEN + r"\s+".join(quoted(w) for w in term.split(" ")) + CLOSE


#: What parts words from each other, as bounded patterns see it.
BETWEEN = r"[^\p{L}\p{N}_]+"


def pieces(term: str) -> list[str]:
    """The runs of letters, digits and underscores of a term."""
    return "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in term).split()


def has_term(folded: Column, term: str, inflect: bool = False) -> Column:
    """Whether a folded text has a term; a plain search for its first word spares most rows the pattern."""
    term = term.casefold().strip()
    if not term:
        return F.lit(False)
    return F.contains(folded, F.lit(term.split(" ")[0])) & folded.rlike(term_pattern(term, inflect))


class Terms:
    """Bounded terms looked up among the words of a folded text, which is split once for all of them.

    A term of one plain word is in the text if one of its forms is a word of it. Other terms need all their words there, and only then
    their pattern. ``has`` collects the words to look for; ``words`` is the column ``name`` that the tests read.
    """

    def __init__(self, folded: str, name: str):
        self.folded, self.name, self.known = folded, name, {}

    def has(self, term: str, inflect: bool = False) -> Column:
        term = term.casefold().strip()
        own = pieces(term)
        if not term:
            return F.lit(False)
        if not own:
            return has_term(F.col(self.folded), term)
        if own == [term]:
            forms = [term, *(term + e for e in ("s", "es", "ed", "ing") if inflect and re.fullmatch("[a-z]+", term))]
            self.known.update(dict.fromkeys(forms))
            return F.array_contains(self.name, term) if len(forms) == 1 else F.arrays_overlap(self.name, F.lit(forms))
        self.known.update(dict.fromkeys(own))
        out = F.lit(True)
        for w in dict.fromkeys(own):
            out &= F.array_contains(self.name, w)
        return out & F.col(self.folded).rlike(term_pattern(term, inflect))

    def any(self, terms, inflect: bool = False) -> Column:
        return any_of(self.has(t, inflect) for t in terms)

    def all(self, terms, inflect: bool = False) -> Column:
        """Those of the terms that the text has, in their order."""
        return F.array_compact(F.array(*[F.when(self.has(t, inflect), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")

    def first(self, terms) -> Column:
        return first_of((self.has(t), t) for t in terms)

    def on(self, df, blob: Column):
        """``df`` with the folded text and its words, for the tests made so far."""
        return pinned(pinned(df, {self.folded: blob}), {self.name: self.words()})

    def words(self) -> Column:
        return F.array_intersect(F.split(self.folded, BETWEEN), F.lit(sorted(self.known)) if self.known else F.array().cast("array<string>"))


def pinned(df, columns: dict):
    """withColumns() whose results are computed once: filters on them are not pushed below, where each use would repeat them."""
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*[c for c in df.columns if c not in columns], F.inline(made))


def any_of(checks) -> Column:
    out = F.lit(False)
    for c in checks:
        out = out | c
    return out


def contains_any(folded: Column, terms) -> Column:
    """Whether a text has one of the terms anywhere; a term that holds another one says nothing more."""
    terms = list(dict.fromkeys(terms))
    return any_of(F.contains(folded, F.lit(t)) for t in terms if not any(o in t for o in terms if o != t))


def first_of(checks) -> Column:
    """Value of the first (check, value) that holds, else null."""
    out = F.lit(None).cast("string")
    for check, value in reversed(list(checks)):
        out = F.when(check, F.lit(value)).otherwise(out)
    return out


def priority(score: Column) -> Column:
    return F.when(score >= 9, "HIGH").when(score >= 6, "MEDIUM").otherwise("LOW")


def confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.35), F.least(F.lit(0.95), score.cast("double") / 10))


def decay(event: Column, as_of: Column, half_life_days: float) -> Column:
    """Half-life weight of an event; the future counts as now, an unknown time too."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(event.cast("timestamp"))) / 86_400_000_000.0)
    return F.pow(F.lit(0.5), F.coalesce(days, F.lit(0.0)) / max(half_life_days, 1e-4))


def country_key(c) -> Column:
    return F.trim(F.regexp_replace(fold(c), r"[^a-z0-9]+", " "))


def days_apart(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(F.date_diff(a, b)), F.lit(9999))


def redacted_url(url) -> Column:
    """API keys in a request URL masked."""
    return F.regexp_replace(text(url), r"((?i:api-?key)=)[^&]*", "$1***")


def quote_if_needed(c: Column) -> Column:
    return F.when(c.rlike(r"[ /]"), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)
