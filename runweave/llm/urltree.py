"""URL filters: explicit rules, and a path-template tree for each host that learns from the pages which rules decide.

Variable path segments (numbers, hashes, dates) become wildcards of their shape, so that pages fall together to a few
shaped paths; the tree is built on their counts, level by level. Under each node a branch stays apart only where its
share of blocked pages differs significantly from its siblings': on the host, on its domain, or over all hosts if several
domains have labels there; similar branches merge to a wildcard. A node whose labelled pages could not split any more
ends in `**`, at whatever depth. A template's blocked share is smoothed towards that of the same template on the domain,
which is smoothed towards that over all hosts, and towards that of its parent on the host. What one domain alone has
labels of does not go over to others. A template is rejected where the smoothed share is high. Labels are the verdicts of
the rules; held_out() measures them on hosts, domains or rules whose labels the tree has not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch, stored

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Standard deviations from which two shares differ; labelled pages that a branch needs to stay apart.
DIFFERENT, LEAST = 2.0, 5
#: Domains that must have labelled pages under a template before it tells anything about further domains.
DOMAINS = 2
#: Weight, in pages, of the same template on a wider level and of the parent on the host; blocked share from which a template
#: is rejected. Chosen on labels of held-out hosts of the given pages.
WEIGHT, OWN, REJECT = 4.0, 1.0, 0.8
#: Shapes of variable segments, by regular expression; the first that fits holds.
SHAPES = (("<num>", r"\A[0-9]+\z"), ("<date>", r"\A[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?\z"), ("<num>.<ext>", r"\A[0-9]+[.][A-Za-z0-9]{1,5}\z"), ("<hex>", r"\A[0-9a-fA-F-]*[0-9][0-9a-fA-F-]{7,}\z"), ("<id>", r"\A[\w.~%-]*[0-9]{3,}[\w.~%-]*\z"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"\A(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def domain(host_: Column) -> Column:
    """The last two labels of a host, without user and port; numeric addresses and single names are themselves.

    No list of public suffixes is at hand: hosts under `co.uk` count as one domain, which only asks for more evidence.
    """
    bare = F.regexp_replace(host_, r"\A[^@]*@|:[0-9]*\z", "")
    return F.when(bare.rlike(r"\A[0-9.]+\z"), bare).otherwise(F.regexp_extract(bare, r"([^.]*\.)?[^.]*\z", 0))


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty where there is no `://`."""
    return F.coalesce(F.regexp_extract(url, r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape(segment: Column) -> Column:
    """The wildcard of a variable segment; other segments are themselves."""
    out = segment
    for name, pattern in reversed(SHAPES):
        out = F.when(segment.rlike(pattern), name).otherwise(out)
    return out


def _shaped(path_: Column) -> Column:
    """The segments by shape."""
    return F.transform(F.filter(F.split(path_, "/"), lambda x: x != ""), shape)


def _apart(b, l, nb, nl):
    """Whether a branch's share b / l differs significantly from that of the rest of its node, of nb blocked in nl pages."""
    rest_b, rest_l, pool = nb - b, nl - l, nb / nl
    z = F.abs(b / l - rest_b / rest_l) / F.sqrt(pool * (1 - pool) * (1 / l + 1 / rest_l))
    return F.when((l < LEAST) | (rest_l < LEAST) | (nb == 0) | (nb == nl), False).otherwise(z >= DIFFERENT)


def _sums(df: DataFrame, *by: str) -> DataFrame:
    """Blocked and labelled pages, and in how many rows some are labelled."""
    return df.groupBy(*by).agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.count_if(F.col("labelled") > 0).alias("several"))


def _differ(branches: DataFrame, name: str, *node: str) -> DataFrame:
    """Columns `node`, seg, and whether that branch's share differs from the rest of its node's, as `name`."""
    whole = branches.groupBy(*node).agg(F.sum("blocked").alias("nb"), F.sum("labelled").alias("nl"))
    return branches.join(whole, list(node)).select(*node, "seg", "several", _apart(*map(F.col, ("blocked", "labelled", "nb", "nl"))).alias(name))


def _named(now: DataFrame) -> DataFrame:
    """(host, template, seg, name, own, own_all): how each branch of this level is called, and its shares once merged.

    now: (host, domain, template, seg, blocked, labelled, share, share_all), without rows whose path has ended. Sums over
    domains are made of those over hosts, and sums over all of those over domains.
    """
    by_host = _sums(now, "host", "domain", "template", "seg")
    by_domain = _sums(by_host, "domain", "template", "seg")
    by_all = _sums(by_domain, "template", "seg")
    up = now.groupBy("host", "template").agg(F.max("share").alias("up"), F.max("share_all").alias("up_all"))
    told = (
        by_host.drop("several")
        .join(_differ(by_host, "on_host", "host", "template").drop("several"), ["host", "template", "seg"])
        .join(_differ(by_domain, "on_domain", "domain", "template").drop("several"), ["domain", "template", "seg"])
        .join(_differ(by_all, "on_all", "template"), ["template", "seg"])
    )
    apart = F.col("on_host") | F.col("on_domain") | (F.col("on_all") & (F.col("several") >= DOMAINS))
    merged = scratch(told.select("host", "domain", "template", "seg", "blocked", "labelled", F.when(apart, F.col("seg")).otherwise("*").alias("name")))

    here = _sums(merged, "host", "domain", "template", "name").drop("several")
    near = _sums(here, "domain", "template", "name")
    far = _sums(near, "template", "name").select("template", "name", F.col("blocked").alias("qb"), F.col("labelled").alias("ql"), "several")
    near = near.select("domain", "template", "name", F.col("blocked").alias("db"), F.col("labelled").alias("dl"))
    shares = here.join(up, ["host", "template"]).join(near, ["domain", "template", "name"]).join(far, ["template", "name"])
    shares = shares.withColumn("own_all", F.when(F.col("several") >= DOMAINS, (F.col("qb") + WEIGHT * F.col("up_all")) / (F.col("ql") + WEIGHT)).otherwise(F.col("up_all")))
    shares = shares.withColumn("own_domain", (F.col("db") + WEIGHT * F.col("own_all")) / (F.col("dl") + WEIGHT))
    own = (F.col("blocked") + WEIGHT * F.col("own_domain") + OWN * F.col("up")) / (F.col("labelled") + WEIGHT + OWN)
    return merged.select("host", "template", "seg", "name").join(shares.select("host", "template", "name", "own_all", own.alias("own")), ["host", "template", "name"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, shaped, template, share): the template and smoothed blocked share of each shaped path.

    pages: (host, shaped array<string>, blocked, labelled), aggregated by host and shaped path. A level is one round over
    the paths that still go on; each round is stored, and the one before removed. A path goes on only where the pages
    under its template, over all hosts, could still split: enough of them labelled, some blocked and some not.
    """
    spark = pages.sparkSession
    total = pages.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2.0)).alias("share_all"))
    by_host = pages.groupBy("host").agg(F.sum("blocked").alias("hb"), F.sum("labelled").alias("hl"))
    root = by_host.crossJoin(F.broadcast(total)).select("host", "share_all", ((F.col("hb") + WEIGHT * F.col("share_all")) / (F.col("hl") + WEIGHT)).alias("share"))
    now, path = stored(pages.join(root, "host").select("*", domain(F.col("host")).alias("domain"), F.lit("").alias("template"), (F.size("shaped") > 0).alias("open")))
    level = 0
    while not now.where("open").isEmpty():
        ended, open_ = now.where("not open"), now.where("open").withColumn("seg", F.col("shaped")[level])
        under = open_.groupBy("template").agg(F.sum("blocked").alias("nb"), F.sum("labelled").alias("nl"))
        splits = under.select("template", ((F.col("nl") >= 2 * LEAST) & (F.col("nb") > 0) & (F.col("nb") < F.col("nl"))).alias("splits"))
        open_ = open_.join(splits, "template")
        stopped = open_.where("not splits").withColumns({"template": F.concat("template", F.lit("/**")), "open": F.lit(False)})
        going = open_.where("splits")
        stepped = going.drop("share", "share_all").join(_named(going), ["host", "template", "seg"]).withColumns(
            {"share": F.col("own"), "share_all": F.col("own_all"), "template": F.concat("template", F.lit("/"), F.col("name")), "open": F.size("shaped") > level + 1}
        )
        before, (now, path) = path, stored(ended.unionByName(stopped.select(*now.columns)).unionByName(stepped.select(*now.columns)))
        remove(spark, before)
        level += 1
    return now.select("host", "shaped", "template", "share")


def _placed(pages: DataFrame, id_col: str, url_col: str, rules) -> DataFrame:
    url = F.col(url_col).cast("string")
    some = pages.select(F.col(id_col).cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    return some.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shaped", _shaped(F.col("path")))


def _tree(some: DataFrame, seen) -> DataFrame:
    """The templates that are learned from the labels of pages for which `seen` holds."""
    label = F.when(seen, F.col("r.verdict"))
    counts = some.groupBy("host", "shaped").agg(F.count_if(label == "block").alias("blocked"), F.count(label).alias("labelled"))
    return scratch(templates(counts))


def held_out(pages: DataFrame, url_col: str = "url", rules=RULES, folds: int = 5, fold: int = 0, by: str = "host") -> DataFrame:
    """(n_labelled, n_blocked, n_rejected, n_right): how templates judge pages whose labels were kept from the tree.

    by: "host", "domain" or "rule"; those are dealt to folds by crc32. n_right of the n_rejected pages are blocked by a
    rule: their quotient is the purity of rejections, n_right / n_blocked their recall. All are 0 where the fold has no
    labelled page.
    """
    some = _placed(pages.withColumn("page_id", F.lit(0)), "page_id", url_col, rules)
    key = {"host": F.col("host"), "domain": domain(F.col("host")), "rule": F.coalesce("r.rule", F.lit(""))}[by]
    out = F.crc32(key.cast("binary")) % folds == fold
    judged = some.join(_tree(some, ~out), ["host", "shaped"]).where(out & F.col("r.verdict").isNotNull())
    blocked, rejected = F.col("r.verdict") == "block", F.col("share") >= REJECT
    return judged.agg(F.count("*").alias("n_labelled"), F.count_if(blocked).alias("n_blocked"), F.count_if(rejected).alias("n_rejected"), F.count_if(blocked & rejected).alias("n_right"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, share): a row for each row of `pages`.

    Where a rule fits, its verdict holds; elsewhere a page is blocked if its template's share is REJECT or more. A null
    url, and one without `://`, has an empty host and path; such pages form a host of their own. Repeated rows and null
    keys keep their rows; ties can't arise; other columns are ignored; an empty table gives no rows. Paths are read
    whole, however deep; `**` stands for segments below a node that can't split.
    """
    some = _placed(pages, id_col, url_col, rules)
    return some.join(_tree(some, F.lit(True)), ["host", "shaped"]).select(
        "page_id", "host", "path", "r.rule", F.coalesce("r.verdict", F.when(F.col("share") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", F.round("share", 6).alias("share")
    )
