"""URL filter: host rules, and a ratio of character language models for the rest.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are
counted over every labelled URL (those that a rule decides).  Each interpolates
the orders 0 to ``ORDER`` after Witten and Bell: a context seen N times with T
different successors gives weight N / (N + T) to its own counts and the rest to
the context without its first character; a context never seen passes everything
on.  A URL's score is the mean over its characters of the two models'
log-likelihood difference.  The threshold is calibrated to the least balanced
error over the labelled URLs, the smallest such, each scored by models counted without
its own fold (one of ``FOLDS`` by hash of host and path); the verdict takes models of all of them.

Characters are folded to lower-case letters, digits, ``./-`` and one class for
all others, so a model's table has BASE ** (ORDER + 1) cells (about 74,000)
however large the corpus is.  The tables go to the tasks as one scalar subquery of that
proven size; scoring indexes it character by character, without a shuffle, in time linear in the
URL's length.  Only DataFrame functions are used.

Cases: a null URL or one without ``://`` has empty host and path, meets no rule
and is judged as an empty text.  Where either class has no labelled URL, what no
rule decides is allowed.  Repeated rows are counted and judged each; URLs of any length are read whole;
a null id stays null; columns other than id and URL aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rule -> what it does to the URLs of its host and its subdomains whose path starts with its path.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

#: Symbol 0 pads the start and 1 ends a URL; these follow, the last standing for any other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-~"
BASE = len(ALPHABET) + 2
ORDER = 2
CELLS = BASE ** (ORDER + 1)
FOLDS = 3
#: Scores are whole numbers of 1 / SCALE nats, so that sums don't depend on their order; means are cut to STEP of them.
SCALE, STEP = 10_000, 100


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """ASCII lower-case host and the path up to the query or fragment; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    lower = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: F.Column, path: F.Column, rules: dict[str, str]) -> F.Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, slash, start = rule.partition("/")
        out = F.when(F.concat(F.lit("."), host).endswith("." + own) & path.startswith(slash + start), F.lit(rule)).otherwise(out)
    return out


def grams(text: F.Column) -> F.Column:
    """Code of the (ORDER + 1)-gram that ends at each character of a text and at its end."""
    folded = F.regexp_replace(F.lower(text), r"(?s)[^a-z0-9./\-]", "~")
    symbols = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) + 1)
    padded = F.concat(F.array(*[F.lit(0)] * ORDER), symbols, F.array(F.lit(1)))
    n, out = F.size(padded) - ORDER, padded
    for k in range(1, ORDER + 1):
        # each place takes up the symbol k places on; shifted arrays are walked together, never indexed
        out = F.zip_with(out, F.slice(padded, k + 1, F.size(padded)), lambda code, c: code * BASE + c)
    return F.slice(out, 1, n)


def score_table(counted: DataFrame, models: int) -> DataFrame:
    """Rows (model, gram, score) for every gram there can be, BASE ** (ORDER + 1) a model, from the accepted and rejected counts of those that occur.

    Order by order, each cell mixes its own counts with the score of its shorter context; a gram that
    no labelled URL has so gets what its shorter contexts give it."""
    table, what = None, ("accepted", "rejected")
    for order in range(ORDER + 1):
        size = BASE ** (order + 1)
        own = counted.groupBy("model", (F.col("gram") % size).alias("g")).agg(*[F.sum(c).alias(c) for c in what])
        per = own.groupBy("model", F.floor(F.col("g") / BASE).alias("context")).agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in what for n, f in (("n", F.sum), ("t", lambda x: F.sum((x > 0).cast("long"))))])
        cells = counted.sparkSession.range(models * size).select(F.floor(F.col("id") / size).cast("int").alias("model"), (F.col("id") % size).alias("g"))
        cells = cells.withColumns({"context": F.floor(F.col("g") / BASE), "short": F.col("g") % BASE**order})
        cells = cells.join(own, ["model", "g"], "left").join(per, ["model", "context"], "left").na.fill(0)
        if table is None:
            cells = cells.withColumns({"a": F.lit(1.0 / BASE), "r": F.lit(1.0 / BASE)})
        else:
            cells = cells.join(table.withColumnRenamed("g", "short"), ["model", "short"])

        def mixed(c, shorter):
            n, t = F.col(f"{c}_n"), F.col(f"{c}_t")
            return F.when(n == 0, F.col(shorter)).otherwise((F.col(c) + t * F.col(shorter)) / (n + t))

        table = cells.select("model", "g", mixed("accepted", "a").alias("a"), mixed("rejected", "r").alias("r"))
    return table.select("model", F.col("g").alias("gram"), F.round((F.log("a") - F.log("r")) * SCALE).cast("long").alias("score"))


def threshold(labelled: DataFrame) -> DataFrame:
    """One row ``cut``: URLs whose mean is below it are rejected; null where a class is missing.

    There are at most a few thousand different means, so one window holds them.
    """
    bins = labelled.groupBy("mean").agg(F.sum((F.col("kind") == "allow").cast("long")).alias("a"), F.sum((F.col("kind") == "block").cast("long")).alias("r"))
    every = Window.partitionBy(F.lit(0))
    below = every.orderBy("mean").rowsBetween(Window.unboundedPreceding, -1)
    lost = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0))
    both = bins.select("mean", lost("a").alias("a_below"), lost("r").alias("r_below"), F.sum("a").over(every).alias("a_all"), F.sum("r").over(every).alias("r_all"))
    error = F.col("a_below") * F.col("r_all") + (F.col("r_all") - F.col("r_below")) * F.col("a_all")
    return both.filter("a_all > 0 and r_all > 0").agg(F.min(F.struct(error.cast("decimal(38,0)").alias("error"), "mean"))["mean"].alias("cut"))


def judge(pages: DataFrame, rules: dict[str, str] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict (allow or block), and mean, the model's score in units of STEP / SCALE nats a character."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    kind = F.lit(None).cast("string")
    for rule, what in rules.items():
        kind = F.when(F.col("rule") == rule, F.lit(what)).otherwise(kind)
    rows = rows.withColumn("kind", kind)
    text = F.concat("host", "path")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)).cast("int"))
    gram = grams(text)
    of = lambda what: F.sum((F.col("kind") == what).cast("long"))
    counted = rows.filter("kind is not null").select("kind", "fold", F.explode(gram).alias("gram")).groupBy("fold", "gram").agg(of("allow").alias("accepted"), of("block").alias("rejected"))
    counted = written(counted, "url-grams")
    # model k lacks fold k; the last one has all
    models = F.array(*[F.when(F.col("fold") != k, F.lit(k)) for k in range(FOLDS)], F.lit(FOLDS))
    scores = written(score_table(counted.withColumn("model", F.explode(F.array_compact(models))), FOLDS + 1), "url-scores")
    cell = F.struct((F.col("model") * CELLS + F.col("gram")).alias("cell"), "score")
    dense = scores.agg(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["score"]).alias("scores"))

    def mean(model: F.Column) -> F.Column:
        total = F.aggregate(gram, F.lit(0).cast("long"), lambda acc, g: acc + F.element_at(F.col("scores"), g + 1 + F.col("first")))
        return rows.withColumns({"scores": dense.scalar(), "first": (model * CELLS).cast("int")}).withColumn("mean", F.floor(total / (F.length(text) + 1) / STEP)).drop("scores", "first")

    cut = written(threshold(mean(F.col("fold")).filter("kind is not null")), "url-cut")
    verdict = F.coalesce("kind", F.when(F.col("mean") < cut.scalar(), F.lit("block")).otherwise(F.lit("allow")))
    return mean(F.lit(FOLDS)).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mean")
