"""Deduplicating new batches against all history: incremental record linkage over page addresses.

Two addresses lead to the same page if their site and numbers agree and their slugs share at least 3/4 of
their distinct words taken together. An index of what was accepted is kept as tables: *variants*, one row
per distinct (site, numbers, word set) with the first row that brought it and its cluster; the *blocking keys*
of each variant; and *moved*, the union-find mapping of cluster representatives. A new batch is reduced to its
own variants, probes the blocking keys of the history (never its rows), scores the candidates with learned
weights, and changes the representatives of the clusters that it touches only.

Blocking keys: sets of a and b words with a Jaccard similarity of t share at least ``ceil(t a)`` words, so two of
the first ``a - ceil(t a) + 2`` words of each in any fixed order (one, for sets of one word). A key is (site, numbers,
two such words); words are ordered by length, longest first, then by hash, since long words are rare ones. A hot site
or one page in many copies doesn't make a hot key: copies are one variant. Nothing is capped.

The score is logistic in the number of common words and of words in both; its weights are learnt from all pairs of
sets of up to ``LEARNT`` words, on which it makes no mistake. It decides for such pairs; those of longer slugs, where
weights learnt from shorter ones could be off by a word, are checked exactly.

Defined results: a null address is the page ''; addresses without a hyphenated part have an empty slug,
which agrees with an empty slug only; repeated rows are the same page; ties in the order of arrival can't
occur if ids are unique (otherwise such rows don't come before each other).
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarrafa.functions.url import site, strip
from tarrafa.session import checkpointed, ensure_checkpoint_dir, names, read_text, remove, write_text

THRESHOLD = 0.75
#: Parameters that only follow visitors, as a pattern over a decoded name.
TRACKING = r"(?i)^(?:utm_.*|fbclid|gclid|dclid|msclkid|yclid|igshid|mc_[ce]id|_ga|_gl|ref|ref_.*|referrer|origem|origin|source|src|from|share|shared|xtor|cmpid|ncid|wt_.*|at_.*|sid|sessionid|phpsessid|jsessionid)$"

#: Most words of the sets that the weights of the score are learnt from.
LEARNT = 24


def labelled_pairs(most: int = LEARNT, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(words in common, words of both sets, whether they are the same page) of all pairs of sets up to a size."""
    return [(c, a + b, int(c >= threshold * (a + b - c))) for a in range(1, most + 1) for b in range(1, most + 1) for c in range(min(a, b) + 1)]


@functools.lru_cache(maxsize=8)
def fit_weights(most: int = LEARNT, threshold: float = THRESHOLD) -> tuple[float, float, float]:
    """Logistic weights (bias, common words, words of both), by Newton's method on the labelled pairs."""
    import numpy as np

    pairs = np.array(labelled_pairs(most, threshold), dtype=float)
    x, y = np.column_stack([np.ones(len(pairs)), pairs[:, :2]]), pairs[:, 2]
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 1e-6 * np.diag([0.0, 1, 1])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3), x.T @ (p - y) + ridge @ w)
        if ((x @ w >= 0) == (y > 0)).all():
            break
    return tuple(float(v) for v in w)


def with_page(df: DataFrame, url: str) -> DataFrame:
    """Adds _site, _numbers and _words (distinct words of the slug, in prefix order) of an address."""
    keep = df.columns
    d = df.withColumn("_u", strip(F.coalesce(F.col(url), F.lit(""))))
    d = d.withColumn("_rest", F.regexp_replace("_u", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|#.*$", ""))
    d = d.withColumns({"_path": F.regexp_extract("_rest", r"^[^?#]*", 0), "_query": F.regexp_extract("_rest", r"\?([^#]*)", 1)})
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    parameters = F.filter(F.split("_query", r"[&;]"), lambda p: (p != "") & ~F.regexp_extract(p, r"^([^=]*)", 1).rlike(TRACKING))
    segments = F.filter(F.split("_path", "/+"), lambda s: s != "")
    d = d.withColumn("_parts", F.concat(F.transform(segments, lambda s: decode(F.replace(s, F.lit("+"), F.lit("%2B")))), F.transform(parameters, lambda p: decode(F.regexp_replace(p, r"^[^=]*=?", "")))))
    bare = F.transform("_parts", lambda s: F.lower(F.regexp_replace(s, r"\.[A-Za-z][A-Za-z0-9]{0,5}$", "")))
    slugs = F.filter(bare, lambda s: F.contains(s, F.lit("-")))
    d = d.withColumns({"_numbers": F.regexp_extract_all(F.array_join("_parts", "/"), F.lit(r"\d+"), F.lit(0)), "_slug": F.aggregate(slugs, F.lit(""), lambda a, s: F.when(F.length(s) > F.length(a), s).otherwise(a))})
    words = F.array_distinct(F.filter(F.split("_slug", "-+"), lambda w: w != ""))
    ordered = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), F.xxhash64(w).alias("h"), w.alias("w")))), lambda s: s["w"])
    return d.select(*keep, site(F.col("_u")).alias("_site"), F.array_join("_numbers", ",").alias("_numbers"), ordered.alias("_words"))


def _keys(threshold: float) -> Column:
    """Blocking keys of _site, _numbers and _words: pairs of the first words; a set of one word or none has one key."""
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must lie between 1/2 and 1: smaller sets may share one word only")
    words = F.col("_words")
    n = F.size(words)
    first = F.slice(words, F.lit(1), n - F.ceil(n * F.lit(threshold)).cast("int") + 2)
    pairs = F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda y: F.xxhash64("_site", "_numbers", x, y)))
    return F.when(n < 2, F.array(F.xxhash64("_site", "_numbers", F.coalesce(F.get(words, F.lit(0)), F.lit(""))))).otherwise(F.array_distinct(F.flatten(pairs)))


def parsed_rows(df: DataFrame, order: list[str], url: str) -> DataFrame:
    """(order columns, _site, _numbers, _words, _variant) of each row; written out, since two steps need it."""
    d = with_page(df.select(*order, url), url).drop(url)
    return checkpointed(d.withColumn("_variant", F.xxhash64("_site", "_numbers", F.array_sort("_words"))))


def variants(rows: DataFrame, order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """One row per distinct page address of ``parsed_rows``: _variant, _first (the least order struct), _words, _keys."""
    v = rows.groupBy("_variant").agg(F.min(F.struct(*order)).alias("_first"), F.any_value("_site").alias("_site"), F.any_value("_numbers").alias("_numbers"), F.any_value("_words").alias("_words"))
    return v.select("_variant", "_first", "_words", _keys(threshold).alias("_keys"))


def links(new: DataFrame, known: DataFrame, threshold: float = THRESHOLD, weights: tuple[float, float, float] | None = None) -> DataFrame:
    """(_a, _b): pairs of different variants, from ``new`` and ``known``, that share a blocking key and are the same page.

    Each pair comes out once per direction in which it was found.
    """
    b, wc, ws = weights or fit_weights(threshold=threshold)
    left = new.select(F.col("_variant").alias("_a"), F.col("_words").alias("_wa"), F.explode("_keys").alias("_key"))
    right = known.select(F.col("_variant").alias("_b"), F.col("_words").alias("_wb"), F.explode("_keys").alias("_key"))
    pairs = left.join(right, "_key").where("_a <> _b")
    common, total = F.size(F.array_intersect("_wa", "_wb")), F.size("_wa") + F.size("_wb")
    same = F.when(F.greatest(F.size("_wa"), F.size("_wb")) <= LEARNT, b + wc * common + ws * total >= 0).otherwise(common >= threshold * (total - common))
    return pairs.where(same).select("_a", "_b").distinct()


def first_on_page(all_variants: DataFrame, found: DataFrame) -> DataFrame:
    """(_variant, _earliest): the least order struct among a variant and those linked with it."""
    firsts = all_variants.select(F.col("_variant").alias("_b"), F.col("_first").alias("_other"))
    near = found.join(firsts, "_b").groupBy(F.col("_a").alias("_variant")).agg(F.min("_other").alias("_other"))
    return all_variants.join(near, "_variant", "left").select("_variant", F.least("_first", F.coalesce("_other", "_first")).alias("_earliest"))


def ingested(df: DataFrame, order: list[str], url: str = "sourceurl", threshold: float = THRESHOLD, groups: int = 1) -> tuple[DataFrame, PageIndex]:
    """(order columns, is_duplicate, cluster) of all rows, and the index they went through.

    Batches (values of the first order column) arrive in order, in ``groups`` ingests of about as many rows each, into
    an index of their own in the checkpoint folder. A batch is checked against what was ingested before and what
    comes before it in its ingest, so the number of groups doesn't change the rows.
    """
    spark, batch = df.sparkSession, order[0]
    index = PageIndex(spark, f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}", order, url, threshold)
    parts = [df]
    if groups > 1:
        # One row per batch in the window; at most ``groups`` rows come to the driver.
        sizes = df.groupBy(batch).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy(F.asc_nulls_first(batch))) - F.col("n"))
        total = F.sum("n").over(Window.partitionBy())
        ends = sizes.withColumn("part", F.floor(F.col("before") * groups / total)).groupBy("part").agg(F.max(batch).alias("end")).orderBy("part")
        ends = [r["end"] for r in ends.collect() if r["end"] is not None]
        last = lambda e: F.coalesce(F.col(batch) <= F.lit(e), F.lit(True))
        parts = [df.where(last(high) if low is None else (F.col(batch) > F.lit(low)) & last(high)) for low, high in zip([None, *ends], ends, strict=False)] or [df]
    out = None
    for part in parts:
        rows = index.ingest(part)
        out = rows if out is None else out.unionByName(rows)
    return out, index


def duplicates(df: DataFrame, order: list[str], url: str = "sourceurl", threshold: float = THRESHOLD, groups: int = 1) -> DataFrame:
    """The order columns of each row for which a row on the same page comes before it, by ``ingested``."""
    return ingested(df, order, url, threshold, groups)[0].where("is_duplicate").select(*order)


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(_node, _root): the least node of each component, by union-find over tables.

    Each round hooks every root to the least root next to it and then shortens all paths; the tables are
    checkpointed per round, and rounds grow with the logarithm of a component's diameter.
    """
    both = edges.select(F.col("_a").alias("_x"), F.col("_b").alias("_y")).union(edges.select("_b", "_a")).distinct()
    both = checkpointed(both)
    roots = both.groupBy(F.col("_x").alias("_node")).agg(F.least(F.min("_y"), F.first("_x")).alias("_root"))
    for _ in range(rounds):
        around = both.join(roots.select(F.col("_node").alias("_y"), F.col("_root").alias("_ry")), "_y").groupBy(F.col("_x").alias("_node")).agg(F.min("_ry").alias("_near"))
        step = roots.join(around, "_node").select("_node", F.least("_root", "_near").alias("_new"), "_root")
        # What a node learns, its old root learns too (hooking); then roots are replaced by their roots.
        hooks = step.groupBy(F.col("_root").alias("_node")).agg(F.min("_new").alias("_hook"))
        hooked = step.join(hooks, "_node", "left").select("_node", F.least("_new", F.coalesce("_hook", "_new")).alias("_new"), "_root")
        jumps = hooked.select(F.col("_node").alias("_new"), F.col("_new").alias("_jump"))
        nxt = checkpointed(hooked.join(jumps, "_new", "left").select("_node", F.least("_new", F.coalesce("_jump", "_new")).alias("_new"), "_root"))
        changed = nxt.where("_new <> _root").limit(1).count()
        roots = nxt.select("_node", F.col("_new").alias("_root"))
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle; raise rounds")
    return roots


def pages(df: DataFrame, order: list[str], url: str = "sourceurl", threshold: float = THRESHOLD, groups: int = 1) -> DataFrame:
    """The order columns and ``page`` of each row: the representative of its cluster of linked addresses, by ``ingested``."""
    rows, index = ingested(df, order, url, threshold, groups)
    return index.present(rows.select(*order, F.col("cluster").alias("page")), "page")


class PageIndex:
    """What was accepted so far, as Parquet tables under ``path``.

    Each ingest writes a generation: *keys* (blocking key, variant) and *variants*, in folders by hash whose number
    follows the generation's rows (``bucket_rows`` of them each), and *moved* clusters, if any were merged. A batch
    opens only the folders its own keys fall into, so what it reads follows its size, not that of the history. ``fan``
    generations of one level are merged into one of the next, so that few are live, and a row is rewritten once per
    level. Representatives move once (afterwards they aren't representatives), so *moved* is only ever added to.

    A manifest per ingest, written last, names the live generations; an index opened on a path goes on after the
    last manifest. Batches must arrive in their order. Tables that no manifest needs any more are removed one ingest
    later, so that readers of the manifest before aren't disturbed.
    """

    def __init__(self, spark, path: str, order: list[str], url: str = "sourceurl", threshold: float = THRESHOLD, bucket_rows: int = 1 << 18, fan: int = 4):
        self.spark, self.path, self.order, self.url, self.threshold = spark, path.rstrip("/"), order, url, threshold
        self.bucket_rows, self.fan = bucket_rows, fan
        done = [n for n in names(spark, f"{self.path}/manifests") if n.isdigit()]
        self.state = json.loads(read_text(spark, f"{self.path}/manifests/{done[-1]}")) if done else {"ingests": 0, "live": [], "old": []}
        self.opened: list[str] = []

    def _read(self, kind: str, generation: dict, buckets: list[int] | None = None) -> DataFrame:
        """A table of a generation, or those of its folders that are named (and there)."""
        root = f"{self.path}/{kind}/{generation['name']}"
        if buckets is None:
            return self.spark.read.parquet(root)
        wanted = [f"{root}/_bucket={b}" for b in sorted(set(buckets) & set(generation[kind]))]
        self.opened += wanted
        schema = generation["schemas"][kind]
        return self.spark.read.schema(schema).option("basePath", root).parquet(*wanted) if wanted else self.spark.createDataFrame([], T._parse_datatype_string(schema))

    def _buckets(self, values: DataFrame, column: str, of: list[dict], kind: str) -> list[list[int]]:
        """For each generation, the folders that the values fall into: at most as many numbers as it has folders."""
        if not of:
            return []
        row = values.agg(*[F.collect_set(F.pmod(F.col(column), F.lit(g["folders"][kind]))).alias(str(i)) for i, g in enumerate(of)]).first()
        return [list(x) for x in row]

    def probe(self, new: DataFrame) -> DataFrame:
        """Variants of the history that share a blocking key with new ones, with the clusters they are in now."""
        live = self.state["live"]
        keys = checkpointed(new.select(F.explode("_keys").alias("_key")).distinct())
        hits = None
        for i, (g, buckets) in enumerate(zip(live, self._buckets(keys, "_key", live, "keys"))):
            hit = self._read("keys", g, buckets).join(keys, "_key", "left_semi").select("_variant", F.lit(i).alias("_in"))
            hits = hit if hits is None else hits.unionByName(hit)
        hits = checkpointed(hits.distinct())
        found = None
        folders = F.get(F.array(*[F.lit(g["folders"]["variants"]) for g in live]), F.col("_in"))
        touched = {r["_in"]: r["b"] for r in hits.groupBy("_in").agg(F.collect_set(F.pmod("_variant", folders)).alias("b")).collect()}
        for i, g in enumerate(live):
            part = self._read("variants", g, touched.get(i, [])).drop("_bucket").join(hits.where(F.col("_in") == i).select("_variant"), "_variant", "left_semi")
            found = part if found is None else found.unionByName(part)
        return self.present(found, "_cluster")

    def present(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with each representative in ``column`` replaced by the present one of its cluster."""
        with_moves = [g for g in self.state["live"] if g["moved"]]
        if not with_moves:
            return df
        moved = None
        for g in with_moves:
            part = self._read("moved", g).select(F.col("_from").alias("_old"), "_to")
            moved = part if moved is None else moved.unionByName(part)
        moved = checkpointed(moved)
        while True:
            df = checkpointed(df.join(moved, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_to", column)).drop("_old", "_to"))
            if df.join(moved, F.col(column) == F.col("_old"), "left_semi").isEmpty():
                return df

    def ingest(self, batch: DataFrame) -> DataFrame:
        """(order columns, is_duplicate, cluster) of the batch; cluster is the least variant of the page's cluster."""
        self.opened = []
        rows = parsed_rows(batch, self.order, self.url)
        new = checkpointed(variants(rows, self.order, self.threshold))
        own = new.withColumn("_cluster", F.col("_variant"))
        if self.state["live"]:
            touched = checkpointed(self.probe(new).select(own.columns))
            fresh = checkpointed(own.join(touched.select("_variant"), "_variant", "left_anti"))
            pool = touched.unionByName(fresh)
        else:
            touched, fresh, pool = own.limit(0), own, own
        found = checkpointed(links(new, pool, self.threshold))
        edges = found.select("_a", "_b").union(touched.where("_variant <> _cluster").select("_variant", "_cluster"))
        roots = connected(edges).withColumnRenamed("_node", "_variant")
        named = checkpointed(first_on_page(pool, found).join(pool.select("_variant", "_cluster"), "_variant").join(roots, "_variant", "left").select("_variant", "_earliest", F.coalesce("_root", "_cluster").alias("_now"), F.col("_cluster").alias("_was")))
        self._write(fresh, named, touched)
        out = rows.select(*self.order, "_variant").join(named, "_variant").select(*self.order, (F.struct(*self.order) > F.col("_earliest")).alias("is_duplicate"), F.col("_now").alias("cluster"))
        return checkpointed(out)

    def _write(self, fresh: DataFrame, named: DataFrame, touched: DataFrame) -> None:
        state = self.state
        number = state["ingests"] + 1
        name = f"{number:09d}"
        kept = fresh.drop("_cluster").join(named.select("_variant", F.col("_now").alias("_cluster")), "_variant")
        keys = fresh.select(F.explode("_keys").alias("_key"), "_variant")
        counts = fresh.agg(F.count("*").alias("v"), F.coalesce(F.sum(F.size("_keys")), F.lit(0)).alias("k")).first()
        moved = checkpointed(named.where("_was <> _now").join(touched.select(F.col("_cluster").alias("_was")).distinct(), "_was", "left_semi").groupBy(F.col("_was").alias("_from")).agg(F.min("_now").alias("_to"))) if state["live"] else None
        live, old = list(state["live"]), []
        live.append(self._generation(name, 0, keys, kept, moved, counts["k"], counts["v"]))
        while len(same := [g for g in live if g["level"] == live[-1]["level"]]) >= self.fan:
            union = lambda kind: functools.reduce(DataFrame.unionByName, [self._read(kind, g) for g in same if g[kind]] or [self._read(kind, same[0], [])])  # noqa: E731, B023
            moves = [self._read("moved", g) for g in same if g["moved"]]
            merged = self._generation(f"{name}-{live[-1]['level'] + 1}", live[-1]["level"] + 1, union("keys").select("_key", "_variant"), union("variants").drop("_bucket"), functools.reduce(DataFrame.unionByName, moves) if moves else None, sum(g["rows"]["keys"] for g in same), sum(g["rows"]["variants"] for g in same))
            old += [g["name"] for g in same]
            live = [g for g in live if g not in same] + [merged]
        state = {"ingests": number, "live": live, "old": old}
        write_text(self.spark, f"{self.path}/manifests/{number:09d}", json.dumps(state))
        for gone in self.state["old"]:
            for kind in ("keys", "variants", "moved"):
                remove(self.spark, f"{self.path}/{kind}/{gone}")
        self.state = state

    def _generation(self, name: str, level: int, keys: DataFrame, kept: DataFrame, moved: DataFrame | None, n_keys: int, n_variants: int) -> dict:
        folders, there, schemas = {}, {}, {}
        for kind, df, column, n in (("keys", keys, "_key", n_keys), ("variants", kept, "_variant", n_variants)):
            folders[kind] = max(1, -(-n // self.bucket_rows))
            bucketed = df.withColumn("_bucket", F.pmod(F.col(column), F.lit(folders[kind])).cast("int"))
            schemas[kind] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bucketed.schema.fields)
            # One file a folder; what is written is read by folder, and within it by the ranges of its pages.
            parts = min(folders[kind], 4096)
            bucketed.repartition(parts, "_bucket").sortWithinPartitions("_bucket", column).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{kind}/{name}")
            there[kind] = [int(x.removeprefix("_bucket=")) for x in names(self.spark, f"{self.path}/{kind}/{name}") if x.startswith("_bucket=")]
        merged = moved is not None and not moved.isEmpty()
        if merged:
            moved.select("_from", "_to").write.mode("overwrite").parquet(f"{self.path}/moved/{name}")
        return {"name": name, "level": level, "folders": folders, "schemas": schemas, "rows": {"keys": n_keys, "variants": n_variants}, "moved": merged, **there}
