"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule fits.

URLs that a rule fits are the labelled ones.  The trees see length, depth, share of digits, entropy of the characters,
number of parameters, and statistics of the host's suffixes (its last label and its last two): how often a suffix
occurs among labelled URLs and how often it is blocked there.  A labelled URL gets its statistics from the three
quarters of the labelled URLs that it is not in, so its own label is no input.

All of it is DataFrame functions.  Features are small integers, so the labelled URLs collapse to one row per distinct
feature vector before the first tree is grown; a level of a tree is one aggregate over that table, and only its sums,
at most ``2**(depth - 1) * len(FEATURES) * BINS`` rows, reach the driver, which picks the splits.  Gradients are summed
as integers, so the trees do not depend on how rows are partitioned.  Suffixes are hashed into ``SUFFIX_BUCKETS``
buckets, which bounds the table of their statistics whatever the input; that table alone is broadcast.

Defined cases: a URL that is null or has no ``://`` has empty host and path, fits no rule and is judged by its (empty)
features; a null id is kept; repeated rows are judged one by one, alike; extra columns are ignored; without any
labelled URL all others are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.plans.scratch import keep

from .tables import slim

FEATURES = ("length", "depth", "digits", "entropy", "parameters", "label_count", "label_share", "domain_count", "domain_share")
BINS = 32
SUFFIX_BUCKETS = 4096
FOLDS = 4
SCALE = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path, as ``example.net/en/``: the path starts at the first slash."""

    text: str
    block: bool

    @property
    def host(self) -> str:
        return self.text[: self.text.index("/")]

    @property
    def path(self) -> str:
        return self.text[self.text.index("/") :]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


# The rules of the query.
RULES = (Rule("net/", True), Rule("example.net/en/", False), Rule("example.com/de/", True), Rule("org/fr/", False))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Number of the longest rule that fits, the first of equally long ones; null where none does."""
    number = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i].text), -i)):
        number = F.when(rules[i].fits(host, path), F.lit(i)).otherwise(number)
    return number


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters: one pass over them in order, adding up n * log2(n) of each run."""
    zero = F.struct(F.lit("").alias("char"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))
    closed = lambda s: s["total"] + F.when(s["run"] > 1, s["run"] * F.log2(s["run"])).otherwise(0.0)

    def step(s: Column, c: Column) -> Column:
        same = s["char"] == c
        return F.struct(c.alias("char"), F.when(same, s["run"] + 1.0).otherwise(1.0).alias("run"), F.when(same, s["total"]).otherwise(closed(s)).alias("total"))

    n = F.char_length(text)
    return F.when(n > 0, F.log2(n) - F.aggregate(F.array_sort(F.split(text, "")), zero, step, closed) / n).otherwise(0.0)


def _capped(value: Column) -> Column:
    return F.greatest(F.least(F.floor(value), F.lit(BINS - 1)), F.lit(0)).cast("int")


def lexical(url: Column, path: Column) -> dict[str, Column]:
    """The features of the URL's text alone, each an integer below ``BINS``."""
    text = F.coalesce(url, F.lit(""))
    n = F.char_length(text)
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    filled = lambda a: F.size(F.array_remove(a, ""))
    return {
        "length": _capped(3 * F.log2(n + 1)), "depth": _capped(filled(F.split(path, "/"))), "digits": _capped(F.when(n > 0, (BINS - 1) * F.regexp_count(text, F.lit("[0-9]")) / n).otherwise(0)),
        "entropy": _capped(4 * entropy(text)), "parameters": _capped(filled(F.split(query, "&"))),
    }


def suffix_buckets(host: Column) -> dict[str, Column]:
    """Buckets of the host's last label and of its last two."""
    return {f"{name}_bucket": F.pmod(F.xxhash64(F.lit(name), F.substring_index(host, ".", -n)), F.lit(SUFFIX_BUCKETS)).cast("int") for name, n in (("label", 1), ("domain", 2))}


def described(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``id, url, host, path, number`` of the rule, ``fold`` and lexical features of ``id, url``."""
    host, path = host_and_path(F.col("url"))
    rows = urls.withColumns({"host": host, "path": path})
    rows = rows.withColumns({"number": longest_rule(F.col("host"), F.col("path"), rules), "fold": F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(FOLDS)).cast("int")})
    return rows.withColumns(lexical(F.col("url"), F.col("path")) | suffix_buckets(F.col("host")))


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """``kind, bucket, seen, blocked``: labelled and blocked URLs of each bucket, by fold; at most 2 * ``SUFFIX_BUCKETS`` rows."""
    each = labelled.select("fold", "blocked", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_bucket").alias("bucket")) for k in ("label", "domain")])).alias("x"))
    of_fold = lambda c, i: F.sum(F.when(F.col("fold") == i, c).otherwise(0))
    seen, blocked = (F.array(*[of_fold(c, i) for i in range(FOLDS)]) for c in (F.lit(1), F.col("blocked")))
    return each.groupBy("x.kind", "x.bucket").agg(seen.alias("seen"), blocked.alias("blocked"))


def with_suffix_features(rows: DataFrame, statistics: DataFrame, own_fold: bool) -> DataFrame:
    """Count and share of blocked URLs of both suffixes; ``own_fold`` leaves the row's own fold out.

    Shares are drawn to one half by four URLs' weight, which is also the share of a suffix not seen.
    """
    for kind in ("label", "domain"):
        named = statistics.where(F.col("kind") == kind).select(F.col("bucket").alias(f"{kind}_bucket"), F.col("seen").alias("__seen"), F.col("blocked").alias("__blocked"))
        rows = rows.join(F.broadcast(named), f"{kind}_bucket", "left")
        total = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) - (F.coalesce(F.element_at(c, F.col("fold") + 1), F.lit(0)) if own_fold else 0)
        n, b = total(F.col("__seen")), total(F.col("__blocked"))
        rows = rows.withColumns({f"{kind}_count": _capped(F.log2(n + 1)), f"{kind}_share": _capped((BINS - 1) * (b + 2) / (n + 4))}).drop("__seen", "__blocked", f"{kind}_bucket")
    return rows


@dataclass
class Tree:
    """``splits[node]`` is (feature, last bin that goes left); children of node i are 2i + 1 and 2i + 2; ``values`` of the leaves."""

    splits: dict[int, tuple[str, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def _descend(self, node: int, at_leaf) -> Column:
        if node not in self.splits:
            return at_leaf(node)
        feature, last = self.splits[node]
        return F.when(F.col(feature) <= last, self._descend(2 * node + 1, at_leaf)).otherwise(self._descend(2 * node + 2, at_leaf))

    def leaf(self) -> Column:
        """Number of the leaf that a row of features falls into."""
        return self._descend(0, lambda node: F.lit(node))

    def value(self) -> Column:
        return self._descend(0, lambda node: F.lit(self.values[node]))


@dataclass
class Boosted:
    """Log-odds ``start`` and trees whose values add to it."""

    start: float
    trees: list[Tree] = field(default_factory=list)

    def log_odds(self) -> Column:
        out = F.lit(self.start)
        for tree in self.trees:
            out = out + tree.value()
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def best_split(sums: dict[tuple[str, int], tuple[int, int]], ridge: float, least: float) -> tuple[float, str, int] | None:
    """(gain, feature, last bin to the left) of largest gain, of equal ones the first; None if no split gains.

    ``sums[feature, bin]`` are a node's gradients and Hessians in units of 1 / ``SCALE``.
    """
    best = None
    for feature in FEATURES:
        bins = sorted(b for f, b in sums if f == feature)
        g_all, h_all = (sum(sums[feature, b][i] for b in bins) for i in (0, 1))
        g = h = 0
        for b in bins[:-1]:
            g, h = g + sums[feature, b][0], h + sums[feature, b][1]
            if min(h, h_all - h) < least * SCALE:
                continue
            score = lambda x, y: x * x / SCALE / (y + ridge * SCALE)
            gain = score(g, h) + score(g_all - g, h_all - h) - score(g_all, h_all)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                best = gain, feature, b
    return best


def boost(vectors: DataFrame, rounds: int = 8, depth: int = 3, rate: float = 0.4, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss on ``FEATURES, n, blocked``: vectors with their numbers of URLs and of blocked ones."""
    n, b = vectors.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    model = Boosted(math.log((b + 0.5) / (n - b + 0.5)))
    for _ in range(rounds if 0 < b < n else 0):
        p = model.probability()
        whole = lambda x: F.round(x * SCALE).cast("long")
        graded = vectors.select(*FEATURES, whole(F.col("n") * p - F.col("blocked")).alias("g"), whole(F.col("n") * p * (1 - p)).alias("h"))
        tree, at, open_nodes = Tree(), {}, {0}
        for level in range(depth):
            cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES]))
            inside = graded.withColumn("node", tree.leaf()).where(F.col("node").isin(*sorted(open_nodes)))
            sums: dict[int, dict] = {node: {} for node in open_nodes}
            for r in inside.select("node", "g", "h", cells.alias("c")).groupBy("node", "c.feature", "c.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums[r["node"]][r["feature"], r["bin"]] = r["g"], r["h"]
            split_now = set()
            for node in sorted(open_nodes):
                found = best_split(sums[node], ridge, least)
                if found is None:
                    continue
                _, feature, last = found
                tree.splits[node] = feature, last
                split_now |= {2 * node + 1, 2 * node + 2}
                for child, left in ((2 * node + 1, True), (2 * node + 2, False)):
                    own = [v for (f, x), v in sums[node].items() if f == feature and (x <= last) == left]
                    at[child] = sum(v[0] for v in own), sum(v[1] for v in own)
            open_nodes = split_now
            if not open_nodes:
                break
        if not tree.splits:
            break
        leaves = {c for node in tree.splits for c in (2 * node + 1, 2 * node + 2)} - set(tree.splits)
        tree.values = {leaf: -rate * at[leaf][0] / (at[leaf][1] + ridge * SCALE) for leaf in leaves}
        model.trees.append(tree)
    return model


def training_vectors(rows: DataFrame, rules: tuple[Rule, ...], statistics: DataFrame) -> DataFrame:
    """The labelled rows of :func:`described` as ``FEATURES, n, blocked``."""
    return with_suffix_features(with_label(rows, rules), statistics, own_fold=True).groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked"))


def with_label(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rows that a rule fits, with ``blocked`` 0 or 1."""
    blocking = [i for i, r in enumerate(rules) if r.block]
    return rows.where("number is not null").withColumn("blocked", F.col("number").isin(*blocking).cast("int"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """``id, host, path, rule, verdict, score``: the rule's verdict, or ``block`` where the trees' probability ``score`` is above one half."""
    rows = described(slim(pages, id=id_col, url=url_col), rules)
    statistics = keep(suffix_statistics(with_label(rows, rules)), "url-suffixes")
    model = boost(keep(training_vectors(rows, rules, statistics), "url-vectors"), **options)
    texts, blocks = (F.array(*[F.lit(x) for x in values]).cast(kind) for values, kind in (([r.text for r in rules], "array<string>"), ([r.block for r in rules], "array<boolean>")))
    scored = with_suffix_features(rows, statistics, own_fold=False).withColumn("score", model.probability())
    ruled = lambda a: F.get(a, F.col("number"))
    verdict = F.when(F.coalesce(ruled(blocks), F.col("score") > 0.5), "block").otherwise("allow")
    return scored.select("id", "host", "path", ruled(texts).alias("rule"), verdict.alias("verdict"), "score")
