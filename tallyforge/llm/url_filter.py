"""URLs judged by rules and, where none fits, by two character models; in DataFrame functions only.

Rules name a host and a path prefix; of those that fit, the longest decides.
URLs that an allowing rule accepts and those that a blocking rule rejects train
a Markov model each over the characters of host and path, digits taken as one.
A character's probability mixes the counts of contexts of three, two, one and
no characters, each weighted against the next shorter one, so an unseen context
falls back smoothly. The score of a URL is the difference of the models'
log-likelihoods over its length. Three sixteenths of the rule-judged URLs, by a
hash of their id, are kept out of the counts; where its two classes are equally many of their own standard
deviations away is the threshold.

Grams are counted once, by partial sums, and so is every shorter context from
the counts of grams; the alphabet of 34 characters and the start bound these
tables by 35^3 * 34 = 1.5 million rows, about 60 MB, whatever the pages. So every
gram of a page meets its weight in a broadcast join, and frequent grams are no
skew.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and has the score of its end alone; with only one class of
rule-judged URLs, or none, everything else is allowed; rows that repeat an id
or have none are judged each; long URLs are judged whole; extra columns are not
read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
CONTEXT, WEIGHT, ALPHABET, CALIBRATION = 3, 4.0, 34, ("0", "1", "2")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> F.Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    out = pages.select("page_id", F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))
    return out.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("*", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled")).drop("r")


def _grams(urls: DataFrame) -> DataFrame:
    """A row for each character of host and path and the end: it and the three before it."""
    text = F.translate(F.concat("host", "path"), UPPER + "123456789", LOWER + "0" * 9)
    text = F.concat(F.lit("^" * CONTEXT), F.regexp_replace(text, "[^a-z0./_-]", "~"), F.lit("$"))
    urls = urls.withColumn("_t", text)
    return urls.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("_t") - CONTEXT), lambda i: F.substring("_t", i, F.lit(CONTEXT + 1))))).drop("_t")


def gram_weights(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log of the accepted model's probability of a gram's last character less the rejected one's. counts(gram, a, r)."""
    out = counts.select("gram", *(F.lit(1.0 / ALPHABET).alias(f"p_{c}") for c in "ar"))
    for n in range(CONTEXT + 1):
        tail = F.substring("gram", CONTEXT - n + 1, n + 1)
        seen = counts.groupBy(tail.alias("tail")).agg(F.sum("a").alias("n_a"), F.sum("r").alias("n_r"))
        head = F.substring("gram", CONTEXT - n + 1, n)
        ctx = counts.groupBy(head.alias("head")).agg(F.sum("a").alias("h_a"), F.sum("r").alias("h_r"))
        out = out.withColumns({"tail": tail, "head": head}).join(seen, "tail").join(ctx, "head")
        out = out.select("gram", *(((F.col(f"n_{c}") + WEIGHT * F.col(f"p_{c}")) / (F.col(f"h_{c}") + WEIGHT)).alias(f"p_{c}") for c in "ar"))
    return out.select("gram", (F.log("p_a") - F.log("p_r")).alias("ratio"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, score, verdict), one row for each row of pages."""
    urls = cut(parsed(pages, rules).withColumn("row", F.monotonically_increasing_id()), "urls")
    kept_out = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 1).isin(*CALIBRATION)
    of = lambda verdict: F.count_if((F.col("ruled") == verdict) & ~kept_out)
    grams = _grams(urls)
    weights = cut(gram_weights(cut(grams.groupBy("gram").agg(of("allow").alias("a"), of("block").alias("r")), "grams")), "weights")
    scores = cut(grams.select("row", "gram").join(F.broadcast(weights), "gram").groupBy("row").agg(F.avg("ratio").alias("score")), "scores")
    scored = urls.join(scores, "row")
    held = scored.where(kept_out & F.col("ruled").isNotNull()).groupBy().agg(
        *(f(F.when(F.col("ruled") == v, F.col("score"))).alias(f"{n}_{v}") for v in ("allow", "block") for n, f in (("m", F.avg), ("s", F.stddev_samp)))
    )
    spread = F.col("s_allow") + F.col("s_block")
    middle = F.when(spread > 0, (F.col("m_allow") * F.col("s_block") + F.col("m_block") * F.col("s_allow")) / spread).otherwise((F.col("m_allow") + F.col("m_block")) / 2)
    # A single row of sums; without both classes its threshold is null and nothing is below it.
    limit = F.broadcast(held.select(middle.alias("limit")))
    verdict = F.coalesce("ruled", F.when(F.col("score") < F.col("limit"), "block").otherwise("allow"))
    return scored.join(limit).select("page_id", "host", "path", "rule", "score", verdict.alias("verdict"))


def op10_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_LEVELS = "".join(
    f"""
p{n} AS (SELECT gram, (na + 4.0 * p_a) / (ha + 4.0) AS p_a, (nr + 4.0 * p_r) / (hr + 4.0) AS p_r FROM (
    SELECT c.gram, p_a, p_r, sum(a) OVER (PARTITION BY {t}) AS na, sum(r) OVER (PARTITION BY {t}) AS nr,
           sum(a) OVER (PARTITION BY {h}) AS ha, sum(r) OVER (PARTITION BY {h}) AS hr FROM c JOIN {prev} USING (gram))),"""
    for n, t, h, prev in (
        (0, "substr(c.gram, 4, 1)", "1", "base"),
        (1, "substr(c.gram, 3, 2)", "substr(c.gram, 3, 1)", "p0"),
        (2, "substr(c.gram, 2, 3)", "substr(c.gram, 2, 2)", "p1"),
        (3, "c.gram", "substr(c.gram, 1, 3)", "p2"),
    )
)
SQL = (
    r"""
WITH u AS (SELECT row_number() OVER () AS row, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
k AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u),
l AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled,
    concat('^^^', regexp_replace(translate(concat(host, path), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0./_-]', '~', 'g'), '$') AS t FROM k),
g AS (SELECT row, page_id, ruled, substr(t, i, 4) AS gram FROM (SELECT *, unnest(range(1, length(t) - 2)) AS i FROM l)),
c AS (SELECT gram, count(*) FILTER (WHERE ruled = 'allow' AND NOT substr(md5(coalesce(page_id::VARCHAR, '')), 1, 1) IN ('0', '1', '2')) AS a, count(*) FILTER (WHERE ruled = 'block' AND NOT substr(md5(coalesce(page_id::VARCHAR, '')), 1, 1) IN ('0', '1', '2')) AS r FROM g GROUP BY gram),
base AS (SELECT gram, 1.0 / 34 AS p_a, 1.0 / 34 AS p_r FROM c),"""
    + _LEVELS
    + r"""
s AS (SELECT row, avg(ln(p_a) - ln(p_r)) AS score FROM g JOIN p3 USING (gram) GROUP BY row),
h AS (SELECT avg(score) FILTER (WHERE ruled = 'allow') AS ma, stddev_samp(score) FILTER (WHERE ruled = 'allow') AS sa,
             avg(score) FILTER (WHERE ruled = 'block') AS mb, stddev_samp(score) FILTER (WHERE ruled = 'block') AS sb
      FROM l JOIN s USING (row) WHERE substr(md5(coalesce(page_id::VARCHAR, '')), 1, 1) IN ('0', '1', '2')),
z AS (SELECT CASE WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) ELSE (ma + mb) / 2 END AS cutoff FROM h)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score < cutoff THEN 'block' ELSE 'allow' END) AS verdict
FROM l JOIN s USING (row), z
"""
)
