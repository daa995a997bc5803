"""Contexts of reports, scores of pairs of them, and what follows: bands, clusters, priorities, savings.

Reports that are alike in everything scored here are one class, named by its smallest id, with a count; pairs are formed
between classes. A class of several reports also has a row with itself, r1 = r2, for the pairs inside it. `pairs` is how many
pairs of reports a row stands for, and class_members() names the class of every report, so that no link is lost.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions import rules
from reportmill.operators.graph import connected_components
from reportmill.operators.shared import cut, numbered, store

# Weights of the dimensions, for pairs given by path and for batches.
WEIGHTS = {
    "A": {"purpose": 0.25, "filters": 0.25, "output": 0.20, "calculations": 0.15, "source": 0.10, "parameters": 0.05},
    "B": {"purpose": 0.35, "source": 0.30, "filters": 0.15, "output": 0.15, "calculations": 0.03, "parameters": 0.02},
}
DIMENSIONS = ("source", "filters", "calculations", "parameters", "purpose", "output")
KEPT, HIGH, MEDIUM = 30, 80, 50
#: Classes in a block; a task scores one pair of blocks.
BLOCK = 4_000
#: A name is heavy in structural() if more reports than this, and more than this share of all, have it.
HEAVY, HEAVY_SHARE = 100, 0.05
#: Tasks a core, at most, that pairs of blocks are dealt to.
TASKS = 16
#: The widest square matrix.
WIDTH = 20_000
# Hours to migrate a file, to consolidate a cluster, and the price of an hour.
FILE_HOURS, CLUSTER_HOURS, HOUR = 8, 12, 75
#: What a context consists of; lists are sorted.
LISTS = ("sources", "tables", "domains", "filters", "calculations", "purposes", "fields", "groups", "signatures")
SINGLE = ("domain", "layout", "purpose")


def outputs(catalog: DataFrame, items: DataFrame, groups: DataFrame) -> DataFrame:
    """(report_id, layout, fields, groups, sums, calculations): what each report shows.

    Charts have no text boxes, so their expressions are no output fields and no calculations."""
    e, boxed = F.col("expression"), F.col("item_type") != "Chart"
    kind = F.when(boxed & rules.is_calculation(e), rules.calculation_type(e))
    names = lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(rules.calculation_fields(x), lambda f: F.lower(f))))))
    i = items.groupBy("report_id").agg(
        names(F.when(boxed, e)).alias("fields"), F.array_sort(F.collect_set(F.when(kind.isNotNull(), F.concat(kind, F.lit(":"), rules.calculation_level(e))))).alias("calculations"),
        F.count_if(kind == "aggregation").alias("sums"), F.count_if(~boxed).alias("charts"), F.count_if(F.col("item_type") == "Table").alias("tables"),
    )
    g = groups.groupBy("report_id").agg(names(e).alias("groups"), F.count_if(F.col("kind") == "column").alias("across"))
    none, zero = F.array().cast("array<string>"), F.lit(0)
    j = catalog.join(i, "report_id", "left").join(g, "report_id", "left")
    return j.select("report_id", rules.layout(F.coalesce("charts", zero), F.coalesce("across", zero), F.coalesce("tables", zero)).alias("layout"), *(F.coalesce(c, none).alias(c) for c in ("fields", "groups", "calculations")), F.coalesce("sums", zero).alias("sums"))


def filters(params: DataFrame, queries: DataFrame) -> DataFrame:
    """(report_id, filter, filter_type): what parameters and WHERE parts filter by, as field:condition_type."""
    n, c = F.col("param_name"), F.col("c")
    p = params.select("report_id", F.concat(F.lower(n), F.lit(":"), rules.condition_type(F.concat(F.lit("Parameter-driven filter: "), n))).alias("filter"), rules.param_filter_type(n).alias("filter_type"))
    q = queries.select("report_id", F.explode("conditions").alias("c")).where(rules.filter_kind(c) != "other")
    return p.unionByName(q.select("report_id", F.concat(rules.filter_field(c), F.lit(":"), rules.condition_type(c)).alias("filter"), rules.filter_type(c).alias("filter_type")))


def contexts(catalog: DataFrame, sources: DataFrame, items: DataFrame, groups: DataFrame, params: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a report with LISTS and SINGLE, and its class key. queries are (report_id, tables, conditions, signature)."""
    some = lambda c: F.array_sort(F.collect_set(c))
    label = F.lower(F.concat("source_name", F.lit(":"), rules.database_name(F.col("connect_string"))))
    s = sources.groupBy("report_id").agg(some(label).alias("sources"))
    f = filters(params, queries).groupBy("report_id").agg(some("filter").alias("filters"), F.count(F.lit(1)).alias("n_filters"), F.count_if(F.col("filter_type") == "date_range").alias("dates"))
    p = params.groupBy("report_id").agg(some(rules.param_purpose(F.col("param_name"))).alias("purposes"))
    q = queries.groupBy("report_id").agg(F.flatten(F.collect_list("tables")).alias("named"), some("signature").alias("signatures"))
    j = outputs(catalog, items, groups)
    for other in (s, f, p, q):
        j = j.join(other, "report_id", "left")
    none, zero = F.array().cast("array<string>"), F.lit(0)
    purpose = rules.purpose(F.coalesce("dates", zero), F.coalesce("n_filters", zero), F.col("sums"), F.size("groups"), F.size("fields"))
    named = F.coalesce("named", none)
    j = j.withColumn("tables", F.array_sort(F.array_distinct(named))).withColumn("domains", F.array_sort(F.transform(named, rules.table_domain)))
    j = j.select("report_id", *(F.coalesce(c, none).alias(c) for c in LISTS), rules.field_domain(F.concat_ws(" ", "fields")).alias("domain"), "layout", purpose.alias("purpose"))
    return j.withColumn("class_key", F.sha2(F.to_json(F.struct(*LISTS, *SINGLE)), 256))


def classes(c: DataFrame) -> DataFrame:
    """Contexts, one row for all that are equal: report_id is their smallest, n their number."""
    return c.groupBy("class_key").agg(F.min("report_id").alias("report_id"), F.count(F.lit(1)).alias("n"), *(F.any_value(x).alias(x) for x in (*LISTS, *SINGLE))).drop("class_key")


def class_members(c: DataFrame) -> DataFrame:
    """(report_id, class_id, copies) of every report."""
    return c.select("report_id", "class_key").join(c.groupBy("class_key").agg(F.min("report_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "class_key").drop("class_key")


def _overlap(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """100 times the overlap of each left list with each right one; 100 where both are empty."""
    index = {x: k for k, x in enumerate({x for row in (*left, *right) for x in row})}
    a, b = (np.zeros((len(rows), len(index)), np.float32) for rows in (left, right))
    for m, rows in ((a, left), (b, right)):
        for k, row in enumerate(rows):
            m[k, [index[x] for x in row]] = 1
    both = (a @ b.T).astype(np.float64)
    union = a.sum(1, dtype=np.float64)[:, None] + b.sum(1, dtype=np.float64)[None, :] - both
    return np.where(union == 0, 100.0, both / np.maximum(union, 1) * 100)


def _equal(left: list[str], right: list[str]) -> np.ndarray:
    return np.array(left, object)[:, None] == np.array(right, object)[None, :]


#: How well tables of a domain go with those of the same one, of a related one, and of others.
SAME, KIN, STRANGE = 1.0, 0.6, 0.1


def _compatible(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Mean over the pairs of two lists of domains; 0 where one is empty."""
    names = sorted({x for row in (*left, *right) for x in row})
    kin = {frozenset(p) for p in rules.RELATED}
    relation = np.array([[SAME if x == y else KIN if frozenset((x, y)) in kin else STRANGE for y in names] for x in names]).reshape(len(names), len(names))
    a, b = (np.array([[row.count(x) for x in names] for row in rows], np.float64).reshape(len(rows), len(names)) for rows in (left, right))
    return a @ relation @ b.T / np.maximum(a.sum(1)[:, None] * b.sum(1)[None, :], 1)


def _keyed(rows: DataFrame) -> DataFrame:
    """classes() with the columns that are scored, as texts."""
    keys = {"sources_key": F.to_json(F.struct("sources", (F.size("domains") > 0).alias("read"))), "domains_key": F.to_json("domains"), "filters_key": F.to_json("filters"), "calculations_key": F.to_json("calculations"), "purposes_key": F.to_json("purposes"),
            "output_key": F.to_json(F.struct("fields", "groups", "domain", "layout")), "plain_key": F.to_json(F.struct("sources", "tables", rules.table_set_domain(F.concat_ws(" ", "tables")).alias("set_domain"), (F.size("domains") > 0).alias("read"))), "purpose_key": F.to_json(F.array("purpose"))}
    return rows.select("report_id", "n", *(v.alias(k) for k, v in keys.items()), *(x for x in rows.columns if x in MORE))


#: Columns of classes that blocks may have beside what is scored.
MORE = ("links_key", "shown", "sigs", "queries", "name", "g")


def _packed(ranged: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(g, block) of the rows of _keyed() with g, or of classes with it, in that order."""
    ranged, order = ranged if "sources_key" in ranged.columns else _keyed(ranged), order or ["purpose_key", "report_id"]

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([(k, "ascending") for k in order]).combine_chunks()
        for k, name in enumerate(t.schema.names):
            if name.endswith("_key"):
                t = t.set_column(k, name, t.column(k).dictionary_encode())
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        return pa.table({"g": pa.array([t.column("g")[0].as_py()], pa.int32()), "block": pa.array([out.getvalue().to_pybytes()], pa.binary())})
    return ranged.groupBy("g").applyInArrow(pack, "g int, block binary")


def dealt(c: DataFrame, by_id: bool = False) -> DataFrame:
    """Classes of contexts in blocks of about BLOCK, a row each: (g, block), a compressed Arrow table of the block's classes.

    Rows may have `links_key`, for pair_keys(), `shown`, a text of the class for pairs_shown(), and `sigs` and `queries`, lists for best_pairs().
    Classes are dealt along purposes and domains, so that a block has few distinct values a column, or along their ids."""
    order = ["report_id"] if by_id else ["purpose_key", "filters_key", "purposes_key", "calculations_key", "domains_key", "report_id"]
    rows = store(_keyed(c if "n" in c.columns else classes(c)))
    n = max(1, -(-rows.count() // BLOCK))
    ranged = rows.repartitionByRange(n, *(["report_id"] if by_id else ["purpose_key", "domains_key", "report_id"])).withColumn("g", F.spark_partition_id())
    return _packed(ranged, order)


def _source(a: list[dict], b: list[dict]) -> np.ndarray:
    """What labels add to the source: all of it where a report reads no table, else three tenths."""
    read = np.array([x["read"] for x in a])[:, None] & np.array([x["read"] for x in b])[None, :]
    listed = _overlap([x["sources"] for x in a], [x["sources"] for x in b])
    return np.where(read, listed * 0.3, listed)


def _plain(a: list[dict], b: list[dict]) -> np.ndarray:
    """Labels and the tables in common, where sets of tables of different domains count little; labels alone where a report reads no table."""
    listed, shared = (_overlap([x[k] for x in a], [x[k] for x in b]) for k in ("sources", "tables"))
    read = np.array([x["read"] for x in a])[:, None] & np.array([x["read"] for x in b])[None, :]
    x, y = (np.array([v["set_domain"] for v in d], object) for d in (a, b))
    fits = (x[:, None] == y[None, :]) | (x == "unknown")[:, None] | (y == "unknown")[None, :]
    return np.where(read, np.where(fits, listed * 0.3 + shared * 0.7, np.minimum(25.0, listed * 0.2 + shared * 0.2)), listed)


def _output(a: list[dict], b: list[dict]) -> np.ndarray:
    """Mean of fields in common (half as much again), domains of the fields, layouts and groups; fields only where there are any."""
    get = lambda k: ([v[k] for v in a], [v[k] for v in b])
    x, y = (np.array(d, object) for d in get("domain"))
    known = (x != "unknown")[:, None] & (y != "unknown")[None, :]
    rest = np.where(known, np.where(x[:, None] == y[None, :], 85.0, 5.0), 25.0) + np.where(_equal(*get("layout")), 100.0, 0.0) * 0.5 + _overlap(*get("groups"))
    fields = get("fields")
    some = np.array([bool(f) for f in fields[0]])[:, None] | np.array([bool(f) for f in fields[1]])[None, :]
    return np.minimum(100.0, np.where(some, (_overlap(*fields) * 1.5 + rest) / 4, rest / 3))


#: Parts of the dimensions: key column and score of its values; a dimension is the sum of its parts.
PARTS = {
    "source": (("sources_key", _source), ("domains_key", lambda a, b: _compatible(a, b) * 100 * 0.7)), "filters": (("filters_key", _overlap),), "calculations": (("calculations_key", _overlap),), "parameters": (("purposes_key", _overlap),),
    "purpose": (("purpose_key", lambda a, b: np.where(_equal([x[0] for x in a], [x[0] for x in b]), 100.0, 0.0)),), "output": (("output_key", _output),),
}
#: Rows of a block that are scored at a time against all of the other, and pairs of classes for each cell of a table that stands for several.
STRIP, MERGED = 32, 16


class Met:
    """Two blocks of classes: ids, sizes, and their scores strip by strip.

    Values are scored once for each two distinct ones, and a pair of classes looks its parts up."""

    def __init__(self, blocks: list[bytes | pa.Table], weights: str, least: float, analyzed: bool) -> None:
        self.same = len(blocks) == 1
        self.sides = [x if isinstance(x, pa.Table) else pa.ipc.open_stream(x).read_all() for x in (blocks[0], blocks[-1])]
        self.ids, self.sizes = ([x.column(c).to_numpy() for x in self.sides] for c in ("report_id", "n"))
        self.least, self.weights, self.tables, self.codes = least, WEIGHTS[weights], {}, {}
        for name, parts in PARTS.items():
            self.tables[name] = []
            for key, score in (("plain_key", _plain),) if name == "source" and not analyzed else parts:
                (u, x), (v, y) = (self.coded(side, key) for side in (0, 1))
                self.tables[name].append((score(u, v), x, y))
        # in millionths, and a little more, which what rounds half of them up
        self.summed = self.merged([(m * (self.weights[k] * 1e6), x, y) for k in ("purpose", "filters", "calculations", "parameters", "source", "output") for m, x, y in self.tables[k]])
        self.summed[0] = (self.summed[0][0] + 1e-3, *self.summed[0][1:])
        self.reach = sum(m.max(1, initial=-np.inf)[x] for m, x, _ in self.summed)

    def coded(self, side: int, key: str) -> tuple[list, np.ndarray]:
        """The distinct values of a key column, and which of them each class has."""
        c = self.sides[side].column(key).chunk(0)
        return [json.loads(v) for v in c.dictionary.to_pylist()], c.indices.to_numpy().astype(np.intp)

    def merged(self, parts: list) -> list:
        """Parts whose sums are the same and that are fewer: those of which the classes have few values together are one table."""
        out, most = parts[:1], len(self.ids[0]) * len(self.ids[1]) // MERGED
        for m, x, y in parts[1:]:
            for i, (n, u, v) in enumerate(out):
                (a, p), (b, q) = (np.unique(one * wide + other, return_inverse=True) for one, other, wide in ((u, x, m.shape[0]), (v, y, m.shape[1])))
                if len(a) * len(b) <= max(most, n.size):
                    (a, c), (b, d) = np.divmod(a, m.shape[0]), np.divmod(b, m.shape[1])
                    out[i] = (n[a][:, b] + m[c][:, d], p.reshape(-1), q.reshape(-1))
                    break
            else:
                out.append((m, x, y))
        return out

    @staticmethod
    def spread(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """m[x, y] of all pairs of x and y, column by column in memory: a row of the turned table is copied at a time."""
        return np.ascontiguousarray(m[x].T).take(y, 0).T

    @classmethod
    def _taken(cls, parts: list, rows: slice) -> np.ndarray:
        out = None
        for m, x, y in parts:
            v = cls.spread(m, x[rows], y)
            out = v if out is None else np.add(out, v, out)
        return out

    def dimension(self, name: str, rows: slice) -> np.ndarray:
        return self._taken(self.tables[name], rows)

    def once(self, rows: slice) -> np.ndarray:
        """Of a block with itself: each pair once, and a class with itself where it has several reports."""
        k = np.arange(rows.start, rows.stop)
        out = k[:, None] <= np.arange(len(self.ids[1]))[None, :]
        out[np.arange(len(k)), k] = self.sizes[0][rows] > 1
        return out

    def strips(self, every: bool = False) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, overall, kept): scores, rounded, and which pairs are above least. Strips that cannot have one are left out, unless
        every is asked for; of the others the columns that cannot have one are not scored and have zero."""
        least, wide = self.least * 1e6, len(self.ids[1])
        for at in range(0, len(self.ids[0]), STRIP):
            rows = slice(at, min(at + STRIP, len(self.ids[0])))
            some = None
            if not every:
                if self.reach[rows].max() < least - 1:
                    continue
                some = np.flatnonzero(sum(m[np.unique(x[rows])].max(0)[y] for m, x, y in self.summed) >= least - 1)
                if not len(some):
                    continue
            if some is None or len(some) > wide // 2:
                total = np.rint(v := self._taken(self.summed, rows), v)
            else:
                total = np.zeros((wide, rows.stop - rows.start))
                total[some] = np.rint(v := self._taken([(m, x, y[some]) for m, x, y in self.summed], rows), v).T
                total = total.T
            keep = total > least
            total /= 1e6
            if self.same:
                keep &= self.once(rows)
            yield rows, total, keep

    def counts(self, rows: slice, keep: np.ndarray) -> np.ndarray:
        """How many pairs of reports each kept pair of classes stands for."""
        n = self.sizes[0][rows].astype(np.float64)
        w = (self.sizes[1][:, None] * n).T * keep
        if self.same:
            k = np.arange(rows.start, rows.stop)
            w[np.arange(len(k)), k] = keep[np.arange(len(k)), k] * (n * (n - 1) / 2)
        return w


def met(blocks: DataFrame, f: Callable[[Met], Iterator[dict]], schema: str, weights: str = "B", least: float = KEPT, analyzed: bool = True) -> DataFrame:
    """The rows that f makes of every two blocks, and of each with itself: f takes a Met and gives dicts of columns.

    A task holds two blocks and a strip of their scores, whatever the size of the catalogue."""
    n = (blocks.agg(F.max("g")).first()[0] or 0) + 1
    spread = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "g", "block", *(x for x in blocks.columns if x == "reach"))
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("g")
        if len(t) == 1 and t.column("i")[0] != t.column("j")[0]:
            return  # the other one has no classes
        m = Met(t.column("block").to_pylist(), weights, least, analyzed)
        m.links = [t.column("reach")[0].values.field(k).to_numpy() for k in ("s1", "s2", "final")] if "reach" in t.schema.names else None
        for out in f(m):
            yield pa.RecordBatch.from_arrays([out[k] if isinstance(out[k], pa.Array) else pa.array(out[k], kinds[v]) for k, v in fields], [k for k, _ in fields])
    # partitions by the pairs of blocks and the cores: their rows are few and small, but not the work on them
    parts = min(n * (n + 1) // 2, TASKS * blocks.sparkSession.sparkContext.defaultParallelism)
    return spread.repartition(max(1, parts), "i", "j").groupBy("i", "j").applyInArrow(run, schema)


def _kept(m: Met, dimensions: tuple[str, ...]) -> Iterator[dict]:
    for rows, total, keep in m.strips():
        x, y = np.nonzero(keep)
        r1, r2, n1, n2 = (v[side][rows][x] if not side else v[side][y] for v in (m.ids, m.sizes) for side in (0, 1))
        count = np.where(r1 == r2, n1 * (n1 - 1) // 2, n1 * n2)
        turned = r1 > r2  # n1 and n2 go with r1 and r2, whichever side those came from
        yield {"r1": np.minimum(r1, r2), "r2": np.maximum(r1, r2), "n1": np.where(turned, n2, n1), "n2": np.where(turned, n1, n2), "pairs": count, **{k: m.dimension(k, rows)[x, y] for k in dimensions}, "overall": total[x, y]}


def scored(c: DataFrame, weights: str = "B", least: float = KEPT, analyzed: bool = True, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(r1, r2, n1, n2, pairs, dimensions, overall) of the pairs of classes above least. c are contexts, or blocks of dealt().

    The pairs are the tasks' output and stored nowhere; what is counted or summed over them has met() with a function of its own."""
    blocks = c if "block" in c.columns else dealt(c)
    return met(blocks, lambda m: _kept(m, dimensions), "r1 long, r2 long, n1 long, n2 long, pairs long, " + "".join(f"{k} double, " for k in dimensions) + "overall double", weights, least, analyzed)


def valued(blocks: DataFrame, names: tuple[str, ...], of: Callable[[Met, slice, np.ndarray], list[np.ndarray]], least: float = KEPT, analyzed: bool = True) -> DataFrame:
    """(r1, r2, names) of the pairs above least, with what of() gives each of them; pairs are the tasks' output and stored nowhere."""
    def rows_of(m: Met) -> Iterator[dict]:
        for rows, total, keep in m.strips():
            x, y = np.nonzero(keep)
            r1, r2 = m.ids[0][rows][x], m.ids[1][y]
            yield {"r1": np.minimum(r1, r2), "r2": np.maximum(r1, r2), **{k: v[x, y] for k, v in zip(names, of(m, rows, total))}}
    return met(blocks, rows_of, "r1 long, r2 long, " + ", ".join(f"{k} double" for k in names), least=least, analyzed=analyzed)


def links_key(more: str, reach: str) -> Column:
    """What pair_keys() needs of a class: its marks, and the marks that it is linked with, as arrays."""
    return F.to_json(F.struct(F.array_sort(more).alias("more"), F.array_sort(reach).alias("reach")))


def pair_keys(blocks: DataFrame, least: float = KEPT) -> DataFrame:
    """(r1, r2) of the pairs above least and of those where one has a mark that the other is linked with."""
    def keys(m: Met) -> Iterator[dict]:
        (u, a), (v, b) = (m.coded(side, "links_key") for side in (0, 1))
        names = {k: i for i, k in enumerate(sorted({k for z in v for k in z["more"]}))}
        asked, had = (np.zeros((len(w), len(names)), np.float32) for w in (u, v))
        for marks, of in ((asked, [z["reach"] for z in u]), (had, [z["more"] for z in v])):
            for k, row in enumerate(of):
                marks[k, [names[x] for x in row if x in names]] = 1
        table = asked @ had.T > 0
        for rows, _, keep in m.strips(every=True):
            linked = table[a[rows]].take(b, 1)
            if m.same:
                linked &= m.once(rows)
            x, y = np.nonzero(keep | linked)
            r1, r2 = m.ids[0][rows][x], m.ids[1][y]
            yield {"r1": np.minimum(r1, r2), "r2": np.maximum(r1, r2)}
    return met(blocks, keys, "r1 long, r2 long", least=least)


def with_links(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Blocks of classes with `sigs`, each with the links (s1, s2, final) of the signatures in it."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, block in zip(b.column("g").to_pylist(), b.column("block").to_pylist()):
                sigs = pc.unique(pa.ipc.open_stream(block).read_all().column("sigs").combine_chunks().flatten())
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(sigs), pa.int32()), sigs], ["g", "s1"])
    of = blocks.mapInArrow(held, "g int, s1 long").join(links, "s1").groupBy("g").agg(F.collect_list(F.struct("s1", "s2", "final")).alias("reach"))
    return blocks.join(of, "g", "left").withColumn("reach", F.coalesce("reach", F.array().cast("array<struct<s1:bigint,s2:bigint,final:double>>")))


def _best(m: Met) -> Callable[[slice], tuple[np.ndarray, np.ndarray]]:
    """Of the rows of a strip and all columns: the best link of their signatures, and which two of their lists, as i times the columns'
    lists' length plus j, reach it: the first i, then the first j. Without a link the best is below nothing."""
    lists = [x.column("sigs").combine_chunks() for x in m.sides]
    names = [np.unique(x.flatten().to_numpy()) for x in lists]
    wide = [int(np.diff(x.offsets.to_numpy()).max(initial=1)) for x in lists]
    codes = []
    for x, known, w in zip(lists, names, wide):  # padded with one more code, which has no links
        n = np.diff(x.offsets.to_numpy())
        c = np.full((len(x), w), len(known))
        c[np.arange(w)[None, :] < n[:, None]] = np.searchsorted(known, x.flatten().to_numpy())
        codes.append(c)
    s1, s2, final = m.links
    some = np.isin(s2, names[1]) & np.isin(s1, names[0])
    a, b, final = np.searchsorted(names[0], s1[some]), np.searchsorted(names[1], s2[some]), final[some]
    order = np.argsort(a, kind="stable")
    a, b, final = a[order], b[order], final[order]
    columns = [np.ascontiguousarray(codes[1][:, j]) for j in range(wide[1])]

    def of(rows: slice) -> tuple[np.ndarray, np.ndarray]:
        here, x = np.unique(codes[0][rows], return_inverse=True)
        x, table = x.reshape(codes[0][rows].shape), np.full((len(here), len(names[1]) + 1), -1.0)
        for k, code in enumerate(here):
            at = slice(*np.searchsorted(a, (code, code + 1)))
            table[k, b[at]] = final[at]
        best, place = np.full((len(columns[0]), len(x)), -1.0).T, np.zeros((len(columns[0]), len(x)), np.int32).T
        for i in range(wide[0]):
            for j in range(wide[1]):
                v = m.spread(table, x[:, i], columns[j])
                more = v > best
                np.copyto(best, v, where=more)
                place[more] = i * wide[1] + j
        return best, place
    of.wide = wide[1]
    return of


def _queries(m: Met) -> list[tuple[np.ndarray, np.ndarray]]:
    lists = [x.column("queries").combine_chunks() for x in m.sides]
    return [(x.flatten().to_numpy(), x.offsets.to_numpy()[:-1] - x.offsets[0].as_py()) for x in lists]


def best_pairs(blocks: DataFrame) -> DataFrame:
    """(r1, r2, q1, q2, final): of every two classes with a link of their signatures the best pair of queries, the smallest ids on a
    tie. Blocks are those of dealt(by_id=True) and with_links(); `queries` of a class, which rise, are of its `sigs`, one each."""
    def rows_of(m: Met) -> Iterator[dict]:
        best, ((p, at1), (q, at2)) = _best(m), _queries(m)
        for at in range(0, len(m.ids[0]), STRIP):
            rows = slice(at, min(at + STRIP, len(m.ids[0])))
            v, place = best(rows)
            x, y = np.nonzero((v >= 0) & m.once(rows) if m.same else v >= 0)
            i, j = np.divmod(place[x, y], best.wide)
            yield {"r1": m.ids[0][rows][x], "r2": m.ids[1][y], "q1": p[at1[rows][x] + i], "q2": q[at2[y] + j], "final": v[x, y]}
    return met(blocks, rows_of, "r1 long, r2 long, q1 long, q2 long, final double")


def both_scorings(blocks: DataFrame, least: float = KEPT) -> DataFrame:
    """merged() of the overall scores above least and of the best pairs of queries, times 100, from the blocks of best_pairs()."""
    def rows_of(m: Met) -> Iterator[dict]:
        best = _best(m)
        for rows, total, keep in m.strips(every=True):
            v, _ = best(rows)
            linked = (v >= 0) & m.once(rows) if m.same else v >= 0
            x, y = np.nonzero(keep | linked)
            first, second, ours, theirs = keep[x, y], linked[x, y], total[x, y], np.rint(v[x, y] * 1e8) / 1e6
            score = np.where(first & second, ours * 0.7 + theirs * 0.3, np.where(first, ours, theirs))
            yield {"r1": m.ids[0][rows][x], "r2": m.ids[1][y], "score": score, "of": first + 2 * second.astype(np.int32)}
    p = met(blocks, rows_of, "r1 long, r2 long, score double, of int", least=least)
    origin = F.when(F.col("of") == 1, "first").when(F.col("of") == 2, "second").otherwise("both")
    return p.select("r1", "r2", F.round(F.col("score") + 1e-9, 3).alias("score"), origin.alias("origin"))


def pairs_shown(blocks: DataFrame, least: float = KEPT) -> DataFrame:
    """(r1, r2, shown1, shown2) of the pairs above least, with the text of each class."""
    def shown(m: Met) -> Iterator[dict]:
        texts = pa.concat_arrays([c for x in m.sides for c in x.column("shown").chunks])
        for rows, _, keep in m.strips():
            x, y = np.nonzero(keep)
            r1, r2 = m.ids[0][rows][x], m.ids[1][y]
            x, y, turned = x + rows.start, y + len(m.ids[0]), r1 > r2
            yield {"r1": np.minimum(r1, r2), "r2": np.maximum(r1, r2), "shown1": texts.take(pa.array(np.where(turned, y, x))), "shown2": texts.take(pa.array(np.where(turned, x, y)))}
    return met(blocks, shown, "r1 long, r2 long, shown1 string, shown2 string", least=least)


def cells(blocks: DataFrame, least: float = KEPT) -> DataFrame:
    """matrix_cells() without the pairs: both directions from the tasks, and the diagonal of the classes that have another."""
    def both(m: Met) -> Iterator[dict]:
        for p in _kept(m, ()):
            some = p["r1"] != p["r2"]
            r1, r2, v = (p[k][some] for k in ("r1", "r2", "overall"))
            yield {"r1": np.concatenate([r1, r2]), "r2": np.concatenate([r2, r1]), "v": np.concatenate([v, v])}
    p = met(blocks, both, "r1 long, r2 long, v double", least=least).withColumn("v", F.round("v", 1))
    return p.union(by_class(blocks, least).where("others > 0").select("class_id", "class_id", F.lit(100.0)))


#: Cells of the square matrix, two bytes each, that a task of square_rows() has in hand, and cells in a batch of its rows.
HELD, WRITTEN = 1 << 25, 1 << 21
#: The texts of 0.0 to 100.0.
_TENTHS = pa.array([f"{k // 10}.{k % 10}" for k in range(1001)])


def square_rows(blocks: DataFrame, least: float = KEPT) -> DataFrame:
    """(report, cells): the square matrix of all classes in the blocks of dealt(by_id=True), a row a class: its cells in order of the
    ids as text with commas, 100 on the diagonal and 0 where a pair is not above least.

    A task has some rows of a block, meets one block after the other with them, and hands the rows on; no cell is stored."""
    n = (blocks.agg(F.max("g")).first()[0] or 0) + 1
    parts = max(1, -(-(n * BLOCK) * BLOCK // HELD))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    spread = blocks.select(every(n).alias("i"), "g", "block").withColumn("part", every(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("g")
        held = dict(zip(t.column("g").to_pylist(), t.column("block").to_pylist()))
        i, part = t.column("i")[0].as_py(), t.column("part")[0].as_py()
        if i not in held:
            return  # a block without classes
        rows = pa.ipc.open_stream(held[i]).read_all()
        some = -(-len(rows) // parts)
        rows = rows.slice(part * some, some)
        ids, tenths, columns = rows.column("report_id").to_numpy(), [], []
        if not len(ids):
            return
        for block in held.values():
            m = Met([rows, block], "B", least, True)
            cells_ = np.zeros((len(ids), len(m.ids[1])), np.uint16)
            for at, total, keep in m.strips():
                cells_[at] = np.floor(total * 10 + 0.5 + 1e-7) * keep
            tenths.append(cells_)
            columns.append(m.ids[1])
        tenths, columns = np.concatenate(tenths, 1), np.concatenate(columns)
        tenths[np.arange(len(ids)), np.searchsorted(columns, ids)] = 1000
        step = max(1, WRITTEN // len(columns))
        for at in range(0, len(ids), step):
            v = tenths[at : at + step]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), _TENTHS.take(pa.array(v.ravel())))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + step]), pc.binary_join(lists, ",")], ["report", "cells"])
    return spread.repartition(n * parts, "i", "part").groupBy("i", "part").applyInArrow(run, "report long, cells string")


def histogram(blocks: DataFrame, dimension: str) -> DataFrame:
    """(score, n): pairs of reports by the rounded score of a dimension."""
    def count(m: Met) -> Iterator[dict]:
        found: dict[float, float] = {}
        parts = []
        for table, x, y in m.tables[dimension]:
            values, code = np.unique(table, return_inverse=True)
            parts.append((values, code.reshape(table.shape), x, y))
        size = int(np.prod([len(p[0]) for p in parts]))
        n = np.zeros(size)
        for rows, _, keep in m.strips():
            code = 0
            for values, of, x, y in parts:
                code = code * len(values) + m.spread(of, x[rows], y)
            n += np.bincount(code.ravel("F"), m.counts(rows, keep).ravel("F"), size)
        for k in np.flatnonzero(n):
            at, score = k, 0.0
            for values, *_ in reversed(parts):
                at, i = divmod(at, len(values))
                score = values[i] + score
            found[score] = found.get(score, 0.0) + n[k]
        yield {"score": np.array(list(found)), "n": np.array(list(found.values()), np.int64)}
    rows = met(blocks, count, "score double, n long")
    return rows.groupBy(F.round(F.col("score") + 1e-9, 4).alias("score")).agg(F.sum("n").alias("n"))


def grouped(blocks: DataFrame, code: Callable[[Met, slice, np.ndarray], np.ndarray], size: int) -> DataFrame:
    """(code, n, total): pairs of reports by a code from 0 to size - 1 that code() gives each pair, and the sum of their overall scores."""
    def count(m: Met) -> Iterator[dict]:
        n, s = np.zeros(size), np.zeros(size)
        for rows, total, keep in m.strips():
            at, w = code(m, rows, total).ravel("F"), m.counts(rows, keep)
            n += np.bincount(at, w.ravel("F"), size)
            s += np.bincount(at, (w * total).ravel("F"), size)
        some = np.flatnonzero(n)
        yield {"code": some, "n": n[some].astype(np.int64), "total": s[some]}
    return met(blocks, count, "code int, n long, total double").groupBy("code").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def bands(blocks: DataFrame, edges: tuple[float, ...], least: float = KEPT) -> DataFrame:
    """(code, n): pairs of reports above least by how many of the edges, which rise, their overall score reaches; no row for none."""
    def count(m: Met) -> Iterator[dict]:
        n, one = np.zeros(len(edges) + 1), all((x == 1).all() for x in m.sizes)
        n1, n2 = (x.astype(np.float64) for x in m.sizes)
        for rows, total, keep in m.strips():
            for k in range(len(edges) + 1):
                of = keep if not k else keep & (total >= edges[k - 1])
                n[k] += np.count_nonzero(of) if one else n1[rows] @ (of @ n2)
                if m.same and not one:
                    at = np.arange(rows.start, rows.stop)
                    n[k] -= of[at - rows.start, at] @ (n1[rows] * (n1[rows] + 1) / 2)
        n[:-1] -= n[1:]
        some = np.flatnonzero(n)
        yield {"code": some, "n": n[some].astype(np.int64)}
    return met(blocks, count, "code int, n long", least=least).groupBy("code").agg(F.sum("n").alias("n"))


def bands_of(edges: tuple[float, ...]) -> Callable[[Met, slice, np.ndarray], np.ndarray]:
    """A code for grouped(): how many of the edges, which rise, the overall score reaches."""
    return lambda m, rows, total: sum((total >= e).astype(np.int8) for e in edges)


def confident(m: Met, rows: slice, total: np.ndarray) -> np.ndarray:
    """A code for grouped(): 0 where three of the dimensions and the overall score are above 80, else 1 where three are below 20, else 2."""
    if not hasattr(m, "ends"):  # how many of the dimensions are high, and eight times how many are low, by the values that decide it
        whole = [(k, m.merged(m.tables[k])) for k in DIMENSIONS]
        m.ends = m.merged([((t > 80) + (t < 20) * np.int8(8), x, y) for _, p in whole if len(p) == 1 for t, x, y in p]), [k for k, p in whole if len(p) > 1]
    parts, rest = m.ends
    n = (total > 80) + (total < 20) * np.int8(8)
    for t, x, y in parts:
        n += m.spread(t, x[rows], y)
    for k in rest:
        v = m.dimension(k, rows)
        n += (v > 80) + (v < 20) * np.int8(8)
    return np.where(n & 7 >= 3, 0, np.where(n >> 3 >= 3, 1, 2))


def by_class(blocks: DataFrame, least: float = KEPT) -> DataFrame:
    """(class_id, total, k, others, pairs_total, pairs) of the classes that have a pair: how many reports each of their reports is
    paired with, k, how many of other classes, the sum of the overall scores over k; and the same over pairs, each counted at one of its classes."""
    def count(m: Met) -> Iterator[dict]:
        a, b = (np.zeros((5, len(x))) for x in m.ids)
        n1, n2 = (n.astype(np.float64) for n in m.sizes)
        for rows, total, keep in m.strips():
            if not keep.any():
                continue
            f = keep.astype(np.float64)
            v, n, own = total * f, n1[rows], 0.0
            if m.same:  # a class with itself counts once, with one report less
                k = np.arange(rows.start, rows.stop)
                own, one = v[k - rows.start, k].copy(), f[k - rows.start, k] * (n - 1)
                f[k - rows.start, k] = v[k - rows.start, k] = 0
                a[:, rows] += np.stack([own * (n - 1), one, one * 0, own * n * (n - 1) / 2, one * n / 2])
            total_, k_ = v @ n2, f @ n2
            a[:, rows] += np.stack([total_, k_, k_, total_ * n, k_ * n])
            b[0] += n @ v
            k_ = n @ f
            b[1] += k_
            b[2] += k_
        for ids, side in ((m.ids[0], a), (m.ids[1], b)):
            some = np.flatnonzero(side[1] > 0)
            yield {"class_id": ids[some], **{k: side[r][some] for r, k in ((0, "total"), (3, "pairs_total"))}, **{k: side[r][some].astype(np.int64) for r, k in ((1, "k"), (2, "others"), (4, "pairs"))}}
    rows = met(blocks, count, "class_id long, total double, k long, others long, pairs_total double, pairs long", least=least)
    return rows.groupBy("class_id").agg(*(F.sum(x).alias(x) for x in ("total", "k", "others", "pairs_total", "pairs")))


def linked(blocks: DataFrame, members: DataFrame, names: tuple[str, ...], of: Callable[[Met, slice, np.ndarray], list[np.ndarray]], least: float = KEPT, analyzed: bool = True) -> DataFrame:
    """(report_id, class_id, links, names): one row a report with its class, the number of reports that it is paired with above
    least, and the means over them of what of() gives each pair; null where there is none. members are those of class_members()."""
    def count(m: Met) -> Iterator[dict]:
        a, b = (np.zeros((1 + len(names), len(x))) for x in m.ids)
        n1, n2 = (n.astype(np.float64) for n in m.sizes)
        for rows, total, keep in m.strips():
            if not keep.any():
                continue
            for r, v in enumerate([keep.astype(np.float64), *(v * keep for v in of(m, rows, total))]):
                if m.same:  # a class with itself counts once, with one report less
                    k = np.arange(rows.start, rows.stop)
                    a[r, rows] += v[k - rows.start, k] * (n1[rows] - 1)
                    v[k - rows.start, k] = 0
                a[r, rows] += v @ n2
                b[r] += n1[rows] @ v
        for ids, side in ((m.ids[0], a), (m.ids[1], b)):
            some = np.flatnonzero(side[0] > 0)
            yield {"class_id": ids[some], "links": side[0][some].astype(np.int64), **{k: side[r][some] for r, k in enumerate(names, 1)}}
    rows = met(blocks, count, "class_id long, links long, " + ", ".join(f"{k} double" for k in names), least=least, analyzed=analyzed)
    sums = rows.groupBy("class_id").agg(*(F.sum(x).alias(x) for x in ("links", *names)))
    n = F.coalesce("links", F.lit(0)).alias("links")
    return members.join(sums, "class_id", "left").select("report_id", "class_id", n, *(F.round(F.col(k) / F.col("links") + 1e-9, 4).alias(k) for k in names))


def by_weights(*weights: str) -> Callable[[Met, slice, np.ndarray], list[np.ndarray]]:
    """For linked() and valued(): the overall score of a pair by each of the weights."""
    return lambda m, rows, total: [sum(m.dimension(k, rows) * w for k, w in WEIGHTS[x].items()) for x in weights]


def at_least(score: float) -> float:
    """What to be above of, in order to be at least score."""
    return float(np.nextafter(score, -np.inf))


def forest(blocks: DataFrame, least: float = HIGH) -> DataFrame:
    """(r1, r2) of pairs from least up that join the same classes as all such pairs: of two blocks a spanning forest."""
    def span(m: Met) -> Iterator[dict]:
        ids = m.ids[0] if m.same else np.concatenate(m.ids)
        label, off, out = np.arange(len(ids)), 0 if m.same else len(m.ids[0]), []
        for rows, _, keep in m.strips():
            for i in np.flatnonzero(keep.any(1)):
                one = rows.start + i
                others = np.flatnonzero(keep[i]) + off
                others = others[label[others] != label[one]]
                if len(others):
                    new, at = np.unique(label[others], return_index=True)
                    out += [(ids[one], ids[x]) for x in others[at]]
                    label[np.isin(label, new)] = label[one]
        e = np.array(out, np.int64).reshape(-1, 2)
        yield {"r1": e.min(1, initial=1 << 62), "r2": e.max(1, initial=-1 << 62)}
    return met(blocks, span, "r1 long, r2 long", least=at_least(least))


def structural(datasets: DataFrame, heavy: int | None = None) -> DataFrame:
    """(r1, r2, profiles, score, pairs) of reports with anything in common, from (report_id, dataset_name, sql_text, source_name, item_name).

    40 for a dataset name in common, 30 for each such dataset with the same text, 20 for a source and 10 for an item in
    common, at most 100. Names meet in lists of their reports. A name that more than heavy reports have (else more than HEAVY
    and HEAVY_SHARE of all, so that heavy names and their sets are few) is taken out of the lists: the heavy names of a report are its profile, named by the smallest report that has it, and reports that share
    heavy names only score as their profiles do. So a row is either a pair of reports that share a rarer name, or, with
    profiles = true, a pair of profiles (r1 = r2 for one with itself) that stands for `pairs` pairs of reports which no row
    of the first kind names. profile_members() has the profile of every report, so all links are there.
    """
    keys, profiles = _keys(datasets, heavy)
    of = profiles.select("report_id", "profile_id")
    blocks = _named_blocks(keys, of)
    near = _blocks_met(blocks, _sharing, "r1 long, r2 long, score long")

    sets = profiles.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"), F.any_value("names").alias("names"))
    each = sets.select("profile_id", F.explode("names").alias("key"))
    pairs = each.toDF("r1", "key").join(each.toDF("r2", "key"), "key").where("r1 <= r2").select("r1", "r2").distinct()
    wide = pairs.join(sets.toDF("r1", "n1", "k1"), "r1").join(sets.toDF("r2", "n2", "k2"), "r2")
    count = F.when(F.col("r1") == F.col("r2"), F.expr("n1 * (n1 - 1) div 2")).otherwise(F.col("n1") * F.col("n2"))
    named = _blocks_met(blocks, _sharing_by_profile, "r1 long, r2 long, n long").groupBy("r1", "r2").agg(F.sum("n").alias("named"))
    wide = wide.select("r1", "r2", _points("k1", "k2").alias("score"), count.alias("all_pairs")).join(named, ["r1", "r2"], "left")
    wide = wide.select("r1", "r2", F.lit(True).alias("profiles"), "score", (F.col("all_pairs") - F.coalesce("named", F.lit(0))).alias("pairs")).where("pairs > 0")
    return near.select("r1", "r2", F.lit(False).alias("profiles"), "score", F.lit(1).cast("long").alias("pairs")).unionByName(wide)


def structural_pairs(datasets: DataFrame) -> DataFrame:
    """(r1, r2, score) of every two reports with anything in common, however many reports have it; points as in structural()."""
    keys, profiles = _keys(datasets, _NEVER)
    return _blocks_met(_named_blocks(keys, profiles.select("report_id", "profile_id")), _sharing, "r1 long, r2 long, score long")


#: More reports than any name has.
_NEVER = 1 << 62
#: Reports in a block of structural() and structural_pairs(), and how many cells or shared names a task has in hand at a time.
NAMED_BLOCK, NAMED_CELLS = 8_000, 1 << 21
#: What two reports have in common: bits by the first letter of a key, one for a rarer name, and equal datasets from bit 4 on, up to two.
_BITS, _RARER = {"d": 1, "s": 2, "i": 4}, 8
#: Points by those bits; two equal datasets reach the most.
_POINTS = np.array([min(100, (40 + 30 * (x >> 4) if x & 1 else 0) + (20 if x & 2 else 0) + (10 if x & 4 else 0)) for x in range(64)], np.int64)


def _named_blocks(keys: DataFrame, of: DataFrame) -> DataFrame:
    """(g, block): reports by the hash of their ids, each with the numbers of its keys that another report has too; reports with none are left out."""
    shared = store(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.monotonically_increasing_id().alias("k")))
    rows = keys.where("report_id IS NOT NULL").join(shared, "key").select("report_id", F.struct("k", F.substring("key", 1, 1).alias("kind"), (~F.col("heavy")).alias("rarer")).alias("x"))
    held = store(rows.groupBy("report_id").agg(F.collect_list("x").alias("keys")).join(of, "report_id", "left"))
    n = max(1, -(-held.count() // NAMED_BLOCK))

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("report_id")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        return pa.table({"g": t.column("g").slice(0, 1), "block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    dealt_out = held.select(F.pmod(F.xxhash64("report_id"), F.lit(n)).cast("int").alias("g"), "report_id", "profile_id", F.col("keys.k").alias("k"), F.col("keys.kind").alias("kind"), F.col("keys.rarer").alias("rarer"))
    return store(dealt_out.groupBy("g").applyInArrow(pack, "g int, block binary"))


def _blocks_met(blocks: DataFrame, f: Callable[[list[pa.Table]], Iterator[list[np.ndarray]]], schema: str) -> DataFrame:
    """The rows, of whole numbers, that f makes of every two blocks and of each with itself. A task has two blocks; pairs are its output and stored nowhere."""
    of = sorted(r.g for r in blocks.select("g").collect())
    names = [x.split()[0] for x in schema.split(", ")]
    spread = blocks.withColumn("o", F.explode(F.array(*map(F.lit, of)).cast("array<int>"))).select(F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "g", "block")

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sides = [pa.ipc.open_stream(x).read_all() for x in t.sort_by("g").column("block").to_pylist()]
        for out in f(sides):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.Table.from_batches(list(batches)))
    # as many partitions as pairs of blocks: their rows are few and small, but not the work on them
    return spread.repartition(max(1, len(of) * (len(of) + 1) // 2), "i", "j").groupBy("i", "j").applyInArrow(runs, schema)


def _entries(t: pa.Table, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, kind, rarer) of every key of the kept reports."""
    lists = t.column("k").combine_chunks()
    row = np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy()))
    kind, rarer = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("kind", "rarer"))
    some = kept[row]
    return row[some], lists.flatten().to_numpy()[some], kind[some].astype("U1"), rarer[some].astype(bool)


def _common(sides: list[pa.Table], kept: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, bits) of the kept reports of two blocks, or of one with itself, that share a rarer name; some rows of the first at a time."""
    same, wide = len(sides) == 1, len(sides[-1])
    column, key, _, _ = _entries(sides[-1], kept[-1])
    order = np.argsort(key, kind="stable")
    column, (known, start) = column[order], np.unique(key[order], return_index=True)
    row, key, kind, rarer = _entries(sides[0], kept[0])
    if not len(known) or not len(key):
        return
    at = np.searchsorted(known, key).clip(max=len(known) - 1)
    row, kind, rarer, at = (x[known[at] == key] for x in (row, kind, rarer, at))
    size = np.diff(np.append(start, len(column)))[at]
    work = np.bincount(row, size, minlength=len(sides[0])).clip(min=wide).cumsum()
    first = 0
    while first < len(sides[0]):
        last = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + NAMED_CELLS, "right")))
        bits, mine = np.zeros((last - first) * wide, np.uint8), slice(*np.searchsorted(row, (first, last)))
        for letter in np.unique(kind[mine]):
            for rare in (True, False):
                some = np.flatnonzero((kind[mine] == letter) & (rarer[mine] == rare)) + mine.start
                n = size[some]
                place = np.repeat(start[at[some]] - (n.cumsum() - n), n) + np.arange(n.sum())
                cell = np.repeat((row[some] - first) * wide, n) + column[place]
                bits[cell] |= _BITS.get(letter, 0) | (_RARER if rare else 0)
                if letter == "q":
                    cell, times = np.unique(cell, return_counts=True)
                    bits[cell] = bits[cell] & 15 | np.minimum((bits[cell] >> 4) + times, 2).astype(np.uint8) << 4
        cell = np.flatnonzero(bits & _RARER)
        x, y = cell // wide + first, cell % wide
        if same:
            once = x < y
            cell, x, y = cell[once], x[once], y[once]
        yield x, y, bits[cell]
        first = last


def _sharing(sides: list[pa.Table]) -> Iterator[list[np.ndarray]]:
    ids = [t.column("report_id").to_numpy() for t in sides]
    for x, y, bits in _common(sides, [np.ones(len(i), bool) for i in ids]):
        r1, r2 = ids[0][x], ids[-1][y]
        yield [np.minimum(r1, r2), np.maximum(r1, r2), _POINTS[bits]]


def _sharing_by_profile(sides: list[pa.Table]) -> Iterator[list[np.ndarray]]:
    """How many pairs of _sharing() two profiles have."""
    kept = [t.column("profile_id").is_valid().to_numpy() for t in sides]
    coded = [np.unique(t.column("profile_id").fill_null(0).to_numpy(), return_inverse=True) for t in sides]
    total = np.zeros((len(coded[0][0]), len(coded[-1][0])), np.int64)
    for x, y, _ in _common(sides, kept):
        total += np.bincount(coded[0][1][x] * total.shape[1] + coded[-1][1][y], minlength=total.size).reshape(total.shape)
    x, y = np.nonzero(total)
    p1, p2 = coded[0][0][x], coded[-1][0][y]
    yield [np.minimum(p1, p2), np.maximum(p1, p2), total[x, y]]


def profile_members(datasets: DataFrame, heavy: int | None = None) -> DataFrame:
    """(report_id, profile_id) of the reports that have heavy names; the others have no profile."""
    return _keys(datasets, heavy)[1].select("report_id", "profile_id")


def _keys(datasets: DataFrame, heavy: int | None) -> tuple[DataFrame, DataFrame]:
    """(report_id, key, heavy) of all names, and (report_id, names, profile_id) of the reports with heavy ones. The first letter of a key says what it names."""
    key = lambda kind, c: F.when(c.isNotNull(), F.concat(F.lit(kind), c))
    query = F.when(F.col("sql_text").isNotNull(), F.to_json(F.struct("dataset_name", "sql_text")))
    every = F.array_compact(F.array(key("d", F.col("dataset_name")), key("q", query), key("s", F.col("source_name")), key("i", F.col("item_name"))))
    rows = store(datasets.select("report_id", F.explode(every).alias("key")).distinct())
    if heavy is None:
        heavy = max(HEAVY, int(rows.select("report_id").distinct().count() * HEAVY_SHARE))
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select("key", F.lit(True).alias("heavy"))
    rows = store(rows.join(many, "key", "left").select("report_id", "key", F.coalesce("heavy", F.lit(False)).alias("heavy")))
    names = rows.where("heavy").groupBy("report_id").agg(F.array_sort(F.collect_list("key")).alias("names"))
    named = names.groupBy(F.sha2(F.to_json("names"), 256).alias("h")).agg(F.min("report_id").alias("profile_id"))
    return rows, names.withColumn("h", F.sha2(F.to_json("names"), 256)).join(named, "h").select("report_id", "names", "profile_id")


def _points(a: str, b: str) -> Column:
    both = F.array_intersect(a, b)
    some = lambda kind: F.exists(both, lambda k: k.startswith(kind))
    equal = F.size(F.filter(both, lambda k: k.startswith("q")))
    return F.least(F.lit(100), F.when(some("d"), 40 + 30 * equal).otherwise(0) + F.when(some("s"), 20).otherwise(0) + F.when(some("i"), 10).otherwise(0)).cast("long")


def overall(weights: str = "B") -> Column:
    return sum((F.col(k) * w for k, w in WEIGHTS[weights].items()), F.lit(0.0))


def confidence() -> Column:
    """By how many of the six dimensions and the overall score are above 80, or below 20."""
    seven = F.array(*map(F.col, (*DIMENSIONS, "overall")))
    return F.when(F.size(F.filter(seven, lambda x: x > 80)) >= 3, 95).when(F.size(F.filter(seven, lambda x: x < 20)) >= 3, 90).otherwise(70)


def mean_over_pairs(c: str = "overall") -> Column:
    return F.sum(F.col(c) * F.col("pairs")) / F.sum("pairs")


def clusters(pairs: DataFrame, members: DataFrame, least: float = HIGH) -> DataFrame:
    """(report_id, component) of reports that are joined by pairs of at least least; members are (report_id, class_id, copies)."""
    near = pairs.where(F.col("overall") >= least)
    joined = connected_components(near.where("r1 < r2").select("r1", "r2"), "r1", "r2")
    alone = near.where("r1 = r2").select(F.col("r1").alias("node"), F.col("r1").alias("component")).join(joined.select("node"), "node", "left_anti")
    return members.join(joined.unionByName(alone).withColumnRenamed("node", "class_id"), "class_id").select("report_id", "component")


def block_clusters(blocks: DataFrame, sums: DataFrame, members: DataFrame, least: float = HIGH) -> DataFrame:
    """clusters() without the pairs, from the blocks of dealt() and the sums of by_class(blocks, at_least(least))."""
    joined = connected_components(forest(blocks, least), "r1", "r2")
    alone = sums.select(F.col("class_id").alias("node"), F.col("class_id").alias("component")).join(joined.select("node"), "node", "left_anti")
    return members.join(joined.unionByName(alone).withColumnRenamed("node", "class_id"), "class_id").select("report_id", "component")


def cluster_table(pairs: DataFrame, members: DataFrame, least: float = HIGH) -> DataFrame:
    """One row a cluster: size, mean similarity of its pairs, and priority."""
    near = pairs.where(F.col("overall") >= least)
    return _cluster_rows(clusters(pairs, members, least), near.groupBy(F.col("r1").alias("class_id")).agg(F.sum(F.col("overall") * F.col("pairs")).alias("pairs_total"), F.sum("pairs").alias("pairs")))


def block_cluster_table(blocks: DataFrame, members: DataFrame, least: float = HIGH) -> DataFrame:
    """cluster_table() without the pairs, from the blocks of dealt()."""
    sums = cut(by_class(blocks, at_least(least)))
    return _cluster_rows(block_clusters(blocks, sums, members, least), sums)


def _cluster_rows(of: DataFrame, sums: DataFrame) -> DataFrame:
    of = cut(of)
    size = of.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    mean = sums.join(of, F.col("class_id") == F.col("report_id")).groupBy("component").agg(F.round(F.sum("pairs_total") / F.sum("pairs") + 1e-9, 4).alias("similarity"))
    return size.join(mean, "component").withColumn("priority", F.when(F.col("size") >= 3, "HIGH").otherwise("MEDIUM"))


def partners(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(report_id, similarity, partners): number of the reports that a report is paired with, and its mean over them."""
    other = pairs.where("r1 < r2").select(F.explode(F.array(F.struct(F.col("r1").alias("class_id"), F.col("n2").alias("k")), F.struct(F.col("r2").alias("class_id"), F.col("n1").alias("k")))).alias("x"), "overall").select("x.*", "overall")
    own = pairs.where("r1 = r2").select(F.col("r1").alias("class_id"), (F.col("n1") - 1).alias("k"), "overall")
    each = other.unionByName(own).groupBy("class_id").agg(F.round(F.sum(F.col("overall") * F.col("k")) / F.sum("k") + 1e-9, 4).alias("similarity"), F.sum("k").alias("partners"))
    return members.join(each, "class_id").select("report_id", "similarity", "partners")


def block_partners(sums: DataFrame, members: DataFrame) -> DataFrame:
    """partners() without the pairs, from the sums of by_class()."""
    return members.join(sums, "class_id").select("report_id", F.round(F.col("total") / F.col("k") + 1e-9, 4).alias("similarity"), F.col("k").alias("partners"))


def representatives(pairs: DataFrame, members: DataFrame, least: float = HIGH) -> DataFrame:
    """The member of each cluster with the highest mean similarity; the smallest id on a tie."""
    return _first(clusters(pairs, members, least).join(partners(pairs.where(F.col("overall") >= least), members), "report_id"))


def block_representatives(blocks: DataFrame, members: DataFrame, least: float = HIGH) -> DataFrame:
    """representatives() without the pairs, from the blocks of dealt()."""
    sums = cut(by_class(blocks, at_least(least)))
    return _first(block_clusters(blocks, sums, members, least).join(block_partners(sums, members), "report_id"))


def _first(m: DataFrame) -> DataFrame:
    first = F.min_by("report_id", F.struct((-F.col("similarity")).alias("s"), "report_id"))
    return m.groupBy("component").agg(first.alias("report_id"), F.max("similarity").alias("similarity"))


def savings(cluster_rows: DataFrame) -> DataFrame:
    """Hours one by one, hours by cluster, what is saved, never below nothing, and the share of files that go."""
    files, n = F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))
    t = cluster_rows.agg((files * FILE_HOURS).alias("single_hours"), (n * CLUSTER_HOURS).alias("cluster_hours"), files.alias("files"), n.alias("clusters"))
    saved = F.greatest(F.lit(0), F.col("single_hours") - F.col("cluster_hours"))
    ratio = F.when(F.col("files") > 0, (F.col("files") - F.col("clusters")) / F.col("files")).otherwise(0.0)
    return t.select("single_hours", "cluster_hours", saved.alias("saved_hours"), (saved * HOUR).alias("saved_cost"), F.round(ratio, 6).alias("ratio"))


def merged(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two scorings of pairs (r1, r2, score): 0.7 of the first and 0.3 of the second where both have the pair, else the one.

    Scores are rounded to three digits, ties upwards whatever their last bits are."""
    key = lambda d, s: d.select(F.least("r1", "r2").alias("r1"), F.greatest("r1", "r2").alias("r2"), F.col("score").alias(s)).groupBy("r1", "r2").agg(F.max(s).alias(s))
    j = key(ours, "x").join(key(theirs, "y"), ["r1", "r2"], "full")
    return j.select("r1", "r2", F.round(F.coalesce(F.col("x") * 0.7 + F.col("y") * 0.3, "x", "y") + 1e-9, 3).alias("score"), F.when(F.col("x").isNull(), "second").when(F.col("y").isNull(), "first").otherwise("both").alias("origin"))


def deduped(pairs: DataFrame) -> DataFrame:
    """One row per unordered pair of clean names: clean names first, then the highest score, then the lowest id."""
    clean = pairs.withColumn("c1", rules.clean_file_name(F.col("f1"))).withColumn("c2", rules.clean_file_name(F.col("f2")))
    own = (F.col("c1") == F.col("f1")) & (F.col("c2") == F.col("f2"))
    k = clean.select(F.least("c1", "c2").alias("k1"), F.greatest("c1", "c2").alias("k2"), own.alias("clean"), "score", (-F.col("id")).alias("m"))
    best = k.groupBy("k1", "k2").agg(F.max(F.struct("clean", "score", "m")).alias("b"))
    return best.select("k1", "k2", F.col("b.score").alias("score"), (-F.col("b.m")).alias("id"))


#: Classes in a block of block_deduped(), which has all rows of two blocks at once.
NAMED = 1_000


def block_deduped(rows: DataFrame, plain: Callable[[np.ndarray, np.ndarray], np.ndarray], number: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float = KEPT) -> DataFrame:
    """deduped() of the pairs r1 < r2 above least, without a shuffle of pairs. rows are classes() with `first` and `second`, the
    clean names that a class has as r1 and as r2; plain() tells of which pairs the names are clean already, number() their ids.

    Classes lie in slots by the hash of their first name, and again by that of their second. A task takes two slots in both
    roles, so it has every pair whose clean names lie in them, whichever of the two is which."""
    held = rows.withColumn("roles", F.array("first", "second"))
    n = max(1, -(-rows.count() // NAMED))
    each = held.select("*", F.posexplode("roles").alias("role", "name")).withColumn("slot", F.pmod(F.xxhash64("name"), F.lit(n)).cast("int"))
    blocks = store(_packed(each.withColumn("g", F.col("slot") * 2 + F.col("role"))))
    met_ = blocks.withColumn("slot", F.expr("g div 2").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("slot", "o").alias("i"), F.greatest("slot", "o").alias("j"), "g", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i, j, of = t.column("i")[0].as_py(), t.column("j")[0].as_py(), dict(zip(t.column("g").to_pylist(), t.column("block").to_pylist()))
        parts, names = [], {}
        for a, b in dict.fromkeys([(2 * i, 2 * j + 1), (2 * j, 2 * i + 1)]):
            if a not in of or b not in of:
                continue
            m = Met([of[a], of[b]], "B", least, True)
            c1, c2 = (np.array([names.setdefault(x, len(names)) for x in side.column("name").to_pylist()], np.int64) for side in m.sides)
            for at, total, keep in m.strips():
                x, y = np.nonzero(keep & (m.ids[0][at][:, None] < m.ids[1]))
                r1, r2 = m.ids[0][at][x], m.ids[1][y]
                parts.append((c1[at][x], c2[y], plain(r1, r2), total[x, y], number(r1, r2)))
        if not parts:
            return
        c1, c2, own, score, number_ = (np.concatenate(c) for c in zip(*parts))
        spelled = sorted(names, key=lambda x: x.encode())
        place = np.empty(len(names), np.int64)
        place[[names[x] for x in spelled]] = np.arange(len(names))
        k1, k2 = np.minimum(place[c1], place[c2]), np.maximum(place[c1], place[c2])
        order = np.lexsort((number_, -score, ~own, k1 * len(names) + k2))
        some = order[np.append(True, np.diff((k1 * len(names) + k2)[order]) != 0)] if len(order) else order
        text = pa.array(spelled, pa.string())
        yield pa.RecordBatch.from_arrays([text.take(pa.array(k1[some])), text.take(pa.array(k2[some])), pa.array(score[some]), pa.array(number_[some])], ["k1", "k2", "score", "id"])
    tasks = min(n * (n + 1) // 2, TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    return met_.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(run, "k1 string, k2 string, score double, id long")


def matrix_cells(pairs: DataFrame) -> DataFrame:
    """The long form of the matrix: both directions and the diagonal."""
    p = pairs.where("r1 <> r2").select("r1", "r2", F.round("overall", 1).alias("v"))
    names = p.select(F.explode(F.array("r1", "r2")).alias("r")).distinct()
    return p.union(p.select("r2", "r1", "v")).union(names.select("r", "r", F.lit(100.0)))


def matrix(pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The square matrix of the classes that occur, (report, cells): a row a class, its cells in order of the ids, 100 on the
    diagonal and 0 where a pair is missing. More than width classes are refused: matrix_cells() is the form for them."""
    cells_ = matrix_cells(pairs)
    return square(cells_, cells_.select("r1").distinct(), width)


def square(cells: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """matrix() from the cells of the long form and the ids that occur in them."""
    names = [r[0] for r in ids.orderBy(ids.columns[0]).limit(width + 1).collect()]
    if len(names) > width:
        raise ValueError(f"a square matrix of more than {width} reports; take matrix_cells() or a larger width")
    order = F.lit(np.array(names, np.int64)) if names and isinstance(names[0], int) else F.array(*map(F.lit, names))
    rows = cells.groupBy(F.col("r1").alias("report")).agg(F.map_from_entries(F.collect_list(F.struct("r2", "v"))).alias("known"))
    return rows.select("report", F.transform(order, lambda x: F.coalesce(F.element_at("known", x), F.lit(0.0))).alias("cells"))


def ranked_priority(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Reports by their number of partners, then by mean similarity."""
    return ranked(partners(pairs, members))


def ranked(of: DataFrame) -> DataFrame:
    """The rows of partners() in that order, with a priority."""
    label = F.when((F.col("similarity") >= 75) & (F.col("partners") >= 3), "HIGH").when(F.col("similarity") >= 50, "MEDIUM").otherwise("LOW")
    return numbered(of.withColumn("priority", label), "place", F.desc("partners"), F.desc("similarity"), "report_id")
