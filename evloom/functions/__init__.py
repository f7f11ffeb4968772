"""Column functions: text normalisation, keys, hashes, scores. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which id wins when an item has several, and its prefix in the key.
KEY_ORDER = (("doi", "doi"), ("arxiv_id", "arxiv"), ("s2_id", "s2"), ("openalex_id", "openalex"))
#: The order in which an external id is picked.
EXTERNAL_ORDER = ("s2_id", "openalex_id", "arxiv_id", "doi")
#: Relations that support, and that contradict.
SUPPORTING, CONTRADICTING = ("supports", "partially_answers"), ("contradicts",)
#: Weights of the five score dimensions.
SCORE_WEIGHTS = {"relevance": 0.25, "authority": 0.30, "recency": 0.15, "novelty": 0.15, "idea_potential": 0.15}


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    return F.nullif(c(x), F.lit(""))


def normalise_title(x) -> Column:
    """Lower case, trimmed, without punctuation (letters, digits and marks of any script stay), single spaces."""
    bare = F.regexp_replace(F.lower(F.trim(c(x))), r"[^\p{L}\p{N}\p{M}_\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def title_hash(x) -> Column:
    return F.sha2(normalise_title(x), 256)


def normalise_query(x) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c(x))), r"\s+", " "))


def identity_key(title="title") -> Column:
    """First id that is not empty, prefixed by its kind; else the title's hash."""
    ids = [F.concat(F.lit(f"{kind}:"), blank_to_null(col)) for col, kind in KEY_ORDER]
    return F.coalesce(*ids, F.concat(F.lit("title:"), title_hash(title)))


def external_id() -> Column:
    return F.coalesce(*[blank_to_null(x) for x in EXTERNAL_ORDER])


def coerce(x, allowed, default: str) -> Column:
    """Values outside an enumeration, and null, become its default."""
    return F.when(c(x).isin(*allowed), c(x)).otherwise(F.lit(default))


def is_weak(relevance) -> Column:
    return F.coalesce(c(relevance), F.lit(0.0)) < 0.5


def clamp(x, lo=0.0, hi=1.0) -> Column:
    return F.least(F.greatest(c(x), F.lit(lo)), F.lit(hi))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b, norm: Column | None = None) -> Column:
    """0 where a vector is empty, of another length or of norm 0. norm: the product of the lengths, where it is known."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) if norm is None else norm
    return F.when((F.size(c(a)) != F.size(c(b))) | (F.size(c(a)) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def jaccard(a, b) -> Column:
    n = F.size(F.array_union(c(a), c(b)))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(c(a), c(b))) / n)


def overlap(a, b) -> Column:
    n = F.least(F.size(F.array_distinct(c(a))), F.size(F.array_distinct(c(b))))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(c(a), c(b))) / n)


def heuristic_score(citations, year, top_venue, abstract, locked) -> Column:
    """Cheap score before the costly one: citations and recency, each at most 3, venue, abstract, less for closed access."""
    recent = F.greatest(F.lit(0.0), F.least((c(year) - 2018) / 2.0, F.lit(3.0)))
    return F.least(F.coalesce(c(citations), F.lit(0)) / 50.0, F.lit(3.0)) + F.coalesce(recent, F.lit(0.0)) + F.when(c(top_venue), 2.0).otherwise(0.0) + F.when(c(abstract), 0.5).otherwise(0.0) - F.when(c(locked), 2.0).otherwise(0.0)


def adjust_authority(authority, citations, year, top_venue) -> Column:
    n = F.coalesce(c(citations), F.lit(0))
    a = F.when((n == 0) & c(year).isNull(), c(authority) * 0.6).when(n == 0, c(authority) * 0.85).when(n >= 100, F.least(c(authority) + 0.1, F.lit(1.0))).when(n >= 10, F.least(c(authority) + 0.05, F.lit(1.0))).otherwise(c(authority))
    return F.when(c(top_venue), F.least(a + 0.1, F.lit(1.0))).otherwise(a)


def weighted_score() -> Column:
    terms = [F.lit(w) * F.col(k) for k, w in SCORE_WEIGHTS.items()]
    return terms[0] + terms[1] + terms[2] + terms[3] + terms[4]


def tier(x, high=0.75, low=0.5, names=("high", "medium", "low")) -> Column:
    return F.when(c(x) >= high, names[0]).when(c(x) >= low, names[1]).otherwise(names[2])


def coverage_score(n, supporting, contradicting) -> Column:
    full = F.least(F.lit(1.0), F.lit(0.4) + 0.1 * c(supporting) + 0.05 * c(contradicting))
    return F.when((c(n) >= 5) & (c(supporting) >= 3), full).when((c(n) >= 3) & (c(supporting) >= 1), F.lit(0.3) + 0.1 * c(supporting)).when(c(n) >= 1, 0.15).otherwise(0.0)


def neighbour_score(hits, families, rank, sources, final) -> Column:
    return 0.4 * c(hits) + 0.3 * c(families) + F.lit(0.2) / (c(rank) + 1) + 0.1 * c(sources) + 0.1 * F.coalesce(c(final), F.lit(0.0))


def idea_score() -> Column:
    """0.2 each of novelty, feasibility, significance, evidence; 0.1 differentiation; 0.05 experiment, impact; less 0.08 risk."""
    big = F.col("novelty") + F.col("feasibility") + F.col("significance") + F.col("evidence")
    return 0.2 * big + 0.1 * F.col("differentiation") + 0.05 * F.col("experiment") + 0.05 * F.col("impact") - 0.08 * F.col("risk")


def token_estimate(x) -> Column:
    """CJK characters count one each, the rest one for each 3.2."""
    cjk = F.length(c(x)) - F.length(F.regexp_replace(c(x), r"[一-鿿]", ""))
    return (cjk + F.ceil((F.length(c(x)) - cjk) / F.lit(3.2))).cast("long")


def nearest_rank(values, p: float) -> Column:
    """sorted[round(p * (n - 1))] with half-even rounding; null for no values."""
    v = F.sort_array(c(values))
    at = F.bround(F.lit(p) * (F.size(v) - 1)).cast("int") + 1
    return F.try_element_at(v, at)


def half_open_bin(x) -> Column:
    """Bins [k/10, (k+1)/10) by comparison; 1.0 and anything outside fall in none."""
    edges = [F.when((c(x) >= k / 10) & (c(x) < (k + 1) / 10), k) for k in range(10)]
    return F.coalesce(*edges)


def arxiv_in_doi(x) -> Column:
    return blank_to_null(F.regexp_extract(F.lower(c(x)), r"arxiv\.(\d{4}\.\d{4,5})", 1))


def strip_prefix(x, prefix: str) -> Column:
    return F.regexp_replace(c(x), "^" + prefix, "")
