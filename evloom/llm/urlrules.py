"""URL filters by mined association rules (operator 8), DataFrame and Spark ML operations only.

URLs become sets of tokens (host labels, path segments, query keys).  FP-growth over the
labelled ones mines token combinations that imply a bad label; rules are pruned by support, by confidence relative to
the share of bad URLs, and by a test that chance would hardly give so many bad ones.  Tokens that occur in exactly the same URLs are
one item while mining, so a long shared path does not make 2^k combinations.  Each rule stands in an inverted index under its rarest token: a URL is compared with
the rules of its own tokens only, and a rule matches if the URL has all of its tokens.  Explicit rules by host and path go first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.common import materialise

BAD = "bad"
#: Least support, confidence as a multiple of the share of bad URLs, and standard deviations of the bad ones above what chance would give.
SUPPORT, LIFT, SIGMAS = 0.002, 1.5, 4.0
#: Labelled URLs that a combination must have in any case, so that small tables don't yield chance rules.
LEAST_URLS = 20
#: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BROADCAST_RULES = 50_000


def host_of(url):
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url):
    """Host labels h:, path segments p: (numbers as p:#), query keys q:, each once."""
    labels = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "#")))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.filter(F.concat(labels, parts, keys), lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, support: float = SUPPORT, lift: float = LIFT, sigmas: float = SIGMAS) -> DataFrame | None:
    """antecedent (array), confidence, support, sigmas of rules that imply bad, from labelled(url, bad boolean). None without bad rows.

    Null labels are left out; a null url has no tokens.  Of tokens with the same URLs a rule names the first by code point.
    """
    baskets = labelled.where("bad is not null").select(F.monotonically_increasing_id().alias("id"), "bad", url_tokens(F.col("url")).alias("tokens"))
    baskets = materialise(baskets, "baskets")
    n, bad = baskets.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if not bad:
        return None
    least = max(support * n, LEAST_URLS)
    single = baskets.select("id", F.explode("tokens").alias("token"))
    often = single.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("of")).where(F.col("n") >= least)
    items = often.groupBy("n", "of").agg(F.min("token").alias("token")).select("token")
    held = single.join(items, "token").groupBy("id").agg(F.collect_list("token").alias("tokens"))
    sets = baskets.select("id", "bad").join(held, "id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    sets = materialise(sets.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")), "sets")
    base = bad / n
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, LEAST_URLS * base / n), minConfidence=min(1.0, base * lift)).fit(sets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    seen = F.col("support") / F.col("confidence") * F.lit(n)
    above = (F.col("confidence") - F.lit(base)) * F.sqrt(seen / F.lit(max(base * (1 - base), 1e-9)))
    rules = rules.select("antecedent", "confidence", "support", above.alias("sigmas"), seen.alias("seen"))
    return materialise(rules.where((F.col("seen") >= least - 0.5) & (F.col("sigmas") >= sigmas) & (F.col("confidence") >= base * lift)).drop("seen"), "rules")


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """token, antecedent: each rule under the rarest of its tokens."""
    seen = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    spelled = rules.select("antecedent", F.explode("antecedent").alias("token")).join(seen, "token", "left")
    return materialise(spelled.groupBy("antecedent").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")), "index")


def _explicit(host, path, rules) -> tuple:
    """The longest rule that fits and its verdict; equally long ones in the order of their text."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, support: float = SUPPORT, lift: float = LIFT, sigmas: float = SIGMAS) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url); labelled(url, bad).

    rules is a short list that becomes one expression; of equal ones the last holds.  Null and odd urls have empty host and path and are allowed.
    Repeated pages are judged alike; an empty table gives no rows; where nothing is mined, what no rule names is allowed.
    """
    url = F.col("url")
    name, verdict = _explicit(F.col("host"), F.col("path"), rules)
    out = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).select("*", name.alias("rule"), verdict.alias("said"))
    mined = mine(labelled, support, lift, sigmas)
    if mined is None:
        return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"))
    found = index(mined, pages)
    small = found.count() <= BROADCAST_RULES
    tokens = pages.where("url is not null").select("url", url_tokens(url).alias("items"))
    hits = tokens.select("url", "items", F.explode("items").alias("token")).join(F.broadcast(found) if small else found, "token")
    hits = materialise(hits.where(F.size(F.array_except("antecedent", "items")) == 0).select("url").distinct().withColumn("hit", F.lit(True)), "hits")
    # Rows without a url have no part in the join, where they would meet in one task.
    named = out.where("url is not null").join(hits, "url", "left").select("page_id", "host", "path", "rule", "said", "hit")
    named = named.unionAll(out.where("url is null").select("page_id", "host", "path", "rule", "said", F.lit(None).cast("boolean")))
    return named.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad: pages with the label of the same id; bad if quality is 0 or toxic is 1."""
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))).alias("bad"))
    return pages.join(bad, F.col("page_id") == F.col("doc_id")).select("url", "bad")
