"""URL filters: fixed host and path rules, then association rules mined from labels.

All of it is DataFrame operations. FP-growth finds the combinations of URL tokens that go with a
label, of all tokens that blocked URLs have often enough; those that are in the same URLs are mined as one. A rule stays if its support is high enough, its confidence is at least
half of the way from the share of blocked URLs to certainty, and none of its parts is as sure. Each rule is filed under its rarest token; a URL's tokens look rules up there and the rest of
the rule is compared.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Host, path and verdict of each fixed rule.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A rule mined needs this share of the labelled URLs and this many of them, and goes so far of the way from the share of blocked URLs to certainty.
SUPPORT, LEAST, SURE = 0.005, 20, 0.5
#: Rules up to this number are sent to all executors; more are joined by a shuffle.
SENT = 10_000
_BLOCK = "=block"


def rest_of(url: Column) -> Column:
    """What follows the first ://, or empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def fixed(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int | None) -> Column:
    """The longest rule that fits as host and path (what None), or its verdict (2). Null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last that is asked wins
        fits = ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
        out = F.when(fits, F.lit(r[0] + r[1] if what is None else r[what])).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, each domain that the host is in, words of the path, names of the query."""
    host, parts = host_of(url), F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    words = F.transform(F.filter(F.split(F.lower(path_of(url)), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("path:"), w))
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)), lambda n: n != ""), lambda n: F.concat(F.lit("key:"), n))
    scheme = F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(scheme), domains, words, names)))


def mine(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, sure: float = SURE) -> DataFrame:
    """tokens, confidence, support, lift (confidence over the share of blocked URLs) of each rule that tells block. labelled: url, block (boolean); rows with nulls are left out. No rows: no rules."""
    rows = labelled.where("url is not null and block is not null")
    n, blocked = rows.agg(F.count(F.lit(1)), F.count_if("block")).first()
    base = blocked / max(n, 1)
    confidence = base + sure * (1 - base)
    none = labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double, lift double")
    share = max(support, least / max(n, 1))
    if share > 1:
        return none
    rows = rows.select("url", "block", tokens_of(F.col("url")).alias("t"))
    # no rule has a token that too few blocked URLs have; tokens of the same URLs have the same rules
    name = F.xxhash64("url").cast("decimal(38,0)"), F.hash("url").cast("decimal(38,0)")
    known = rows.select("block", *(x.alias(k) for x, k in zip(name, ("x", "y"), strict=True)), F.explode("t").alias("token"))
    known = known.groupBy("token").agg(F.count_if("block").alias("blocked"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).where(F.col("blocked") >= share * n - 1e-6)
    classes = known.groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("same")).select(F.col("same")[0].alias("token"), "same")
    mined = classes.agg(F.collect_list("token")).scalar()  # one value, of no more than 1 / share of a URL's tokens
    items = rows.select(F.array_intersect("t", mined).alias("t"), "block").select(F.when(F.col("block"), F.concat("t", F.array(F.lit(_BLOCK)))).otherwise(F.col("t")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share - 1e-12, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0] == _BLOCK).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    rules = rules.where(~F.array_contains("tokens", _BLOCK))
    # a rule one of whose parts is as sure adds nothing: look up each part with one token less
    parts = rules.select("tokens", "confidence", F.explode("tokens").alias("t")).select("tokens", "confidence", F.array_remove("tokens", F.col("t")).alias("part"))
    known = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"))
    idle = parts.join(known, "part").where("c >= confidence").select("tokens").distinct()
    rules = rules.join(idle, "tokens", "left_anti").withColumn("id", F.col("tokens"))
    # each token may be any of those in the same URLs
    same = rules.select("id", "confidence", "support", F.explode("tokens").alias("token")).join(F.broadcast(classes), "token").groupBy("id").agg(F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.collect_list("same").alias("same"))
    every = F.aggregate("same", F.expr("array(cast(array() as array<string>))"), lambda acc, ms: F.flatten(F.transform(acc, lambda a: F.transform(ms, lambda m: F.concat(a, F.array(m))))))
    return same.select(F.explode(every).alias("tokens"), "confidence", "support").select(F.array_sort("tokens").alias("tokens"), "confidence", "support", (F.col("confidence") / F.lit(base)).alias("lift"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, once for each distinct one that has all tokens of some rule."""
    share = rules.select("support", F.explode("tokens").alias("token")).groupBy("token").agg(F.max("support").alias("s"))
    filed = rules.select("tokens", F.explode("tokens").alias("token")).join(share, "token").groupBy("tokens").agg(F.min_by("token", F.struct("s", "token")).alias("token"))
    own = urls.select("url").where("url is not null").distinct().select("url", tokens_of(F.col("url")).alias("own"))
    asked = own.select("url", "own", F.explode("own").alias("token"))
    filed = common.cut_lineage(filed)  # made by rounds of joins, and counted before it is sent
    filed = F.broadcast(filed) if filed.count() <= SENT else filed
    return asked.join(filed, "token").where(F.size(F.array_except("tokens", "own")) == 0).select("url").distinct()


def judge(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    A fixed rule's verdict goes first, else block if a mined rule matches, else allow. Null
    url or one without :// has empty host and path and is allowed.
    """
    hit = matched(pages, mined).select(F.col("url").alias("hit"))
    own = pages.select(F.col("page_id").cast("long"), "url")
    own = own.join(hit, own["url"] == hit["hit"], "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = own.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "hit")
    by = F.when(F.col("hit").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return own.select("page_id", "host", "path", fixed(F.col("host"), F.col("path"), rules, None).alias("rule"), F.coalesce(fixed(F.col("host"), F.col("path"), rules, 2), by).alias("verdict"))


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of a page are those of its number: toxic ones are to be blocked.

    A page with several labels is blocked if one is toxic; null labels tell nothing. Rows of pages that repeat each have a row; a null
    page_id has no label. No labels: no mined rule. No pages: no rows.
    """
    toxic = labels.where("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("block"))
    own = pages.select("page_id", "url")
    return judge(own, mine(own.join(toxic, own["page_id"] == toxic["doc_id"]).select("url", "block")))


def fixed_rows(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and the fixed rules' verdict alone, which is null if none fits."""
    url = F.col("url")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    return own.select("*", *(fixed(F.col("host"), F.col("path"), RULES, what).alias(n) for n, what in (("rule", None), ("verdict", 2))))


#: The fixed rules in DuckDB.
FIXED = f"""with ru(h, p, v) as (values {", ".join(map(str, RULES))}),
u as (select page_id, row_number() over () as r, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
s as (select page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select r, h || p as rule, v, row_number() over (partition by r order by length(h || p) desc) as k from s join ru on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, v as verdict from s left join m on m.r = s.r and k = 1"""

#: All of it in DuckDB; combinations grow by a token at a time, with the lists of URLs that have them.
ORACLE = (
    r"""with recursive uu as (select distinct url, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages where url is not null),
hp as (select url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as q from uu),
tk as (select url, unnest(list_distinct(['scheme:' || lower(split_part(url, '://', 1))] || list_transform(generate_series(1, len(string_split(host, '.'))), lambda i: 'host:' || array_to_string(string_split(host, '.')[i:], '.'))
  || list_transform(list_filter(string_split_regex(lower(path), '[^\pL\pN]+'), lambda w: w <> ''), lambda w: 'path:' || w) || list_transform(list_filter(list_transform(string_split(q, '&'), lambda p: split_part(p, '=', 1)), lambda w: w <> ''), lambda w: 'key:' || w))) as t from hp where host <> ''),
lb as (select row_number() over () as u, url, block from pages join (select doc_id, max(toxic) > 0 as block from labels where toxic is not null group by 1) on doc_id = page_id where url is not null),
n as (select count(*) as n, count(*) filter (block) as b, greatest("""
    + f"{SUPPORT}, {LEAST}.0"
    + r""" / greatest(count(*), 1)) as share from lb),
sg as (select t, us, bs from (select t, list(u) as us, list(u) filter (block) as bs from lb join tk using (url) group by t), n where len(bs) >= share * n - 1e-6),
it(items, tail, us, bs) as (select [t], t, us, bs from sg union all select list_append(items, s.t), s.t, list_intersect(it.us, s.us), list_intersect(it.bs, s.bs) from it, sg s, n where s.t > it.tail and len(list_intersect(it.bs, s.bs)) >= share * n - 1e-6),
ru as (select items, len(bs) / len(us) as c from it, n where len(bs) / len(us) >= b / n + """
    + f"{SURE}"
    + r""" * (1 - b / n)),
mi as (select items from ru a where not exists (select 1 from ru p where len(p.items) = len(a.items) - 1 and list_has_all(a.items, p.items) and p.c >= a.c)),
hi as (select distinct url from (select url, list(t) as ts from tk group by url) join mi on list_has_all(ts, items)),
fx as ("""
    + FIXED.replace("select page_id, coalesce", "select page_id, s.r, coalesce")
    + """) select fx.page_id, host, path, rule, coalesce(fx.verdict, case when hi.url is null then 'allow' else 'block' end) as verdict from fx join (select row_number() over () as r, url from pages) pu on pu.r = fx.r left join hi on hi.url = pu.url"""
)
