"""N-gram Jaccard join: links between all documents whose shingle sets are similar, by adaptive multi-match prefixes.

Shingles are put in one order for all documents, rare ones first. Two sets that share `a` shingles share `l` of those
among the first n - a + l of each, for any l. A document's l grows with the estimated number of candidates that its
prefix would bring; a pair then has to share the smaller l of the two before it is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.bytetext import U, mixed, shingles, slices
from engram.llm.shared import HOT, components, discard, materialise, spread_join

#: Cells of the sketch of shingle frequencies, in two rows: a bound that no input raises.
CELLS = 1 << 20
PARTS = 32
#: Rounds that look for classes with too few shared shingles. More would only leave out some more work.
ROUNDS = 1
#: Shingles of prefixes that a task holds before it settles and sends them.
HELD = 1 << 18
#: From so many open documents on a shingle is crowded, and its documents are compared block by block.
CROWD = 48
BLOCK = 512


def _sets(batch: pa.RecordBatch, size: int):
    """(id, sorted distinct shingles) of each text."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for row, end, data, at in slices(batch.column(1)):
        h, of = shingles(data, at, size)
        text = np.repeat(np.arange(end - row), np.diff(of))
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, dtype=bool)
        h, text = h[new], text[new]
        of = np.searchsorted(text, np.arange(end - row + 1))
        yield ids[row:end], h, of


def signatures(docs: DataFrame, size: int = 5) -> tuple[DataFrame, np.ndarray]:
    """docs (doc, text) -> (doc, n, lo, hi), the size of each set and a 128-bit fingerprint of it; and a sketch of how often shingles occur.

    The sketch is a count-min sketch, 2 x CELLS, as log2 in quarters. A task gives its counts, and Spark sums them part by part.
    """

    def sign(batches):
        total = np.zeros((2, CELLS), dtype=np.uint32)
        none = lambda n, kind: pa.nulls(n, kind)
        for batch in batches:
            out = [[], [], []]
            for _, h, of in _sets(batch, size):
                n = np.diff(of)
                for row, cell in zip(total, _cells(h), strict=True):
                    row += np.bincount(cell, minlength=CELLS).astype(np.uint32)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([np.zeros(1, dtype=U), np.cumsum(mixed(h ^ U(k)))]) for k in (0x51, 0xA3)]
                    prints = [mixed(s[of[1:]] - s[of[:-1]] + n.astype(U)).view(np.int64) for s in sums]
                for c, x in zip(out, (n, *prints), strict=True):
                    c.append(x)
            cols = [pa.array(np.concatenate(c) if c else np.zeros(0, dtype=np.int64), pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, none(len(batch), pa.int32()), none(len(batch), pa.binary())], names)
        parts = np.split(total, PARTS, axis=1)
        yield pa.RecordBatch.from_arrays([*[none(PARTS, pa.int64())] * 4, pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), dtype=np.uint32).astype(np.uint64) for b in table.column("block"))
        level = np.round(4 * np.log2(total + 1.0)).astype(np.uint8)
        return pa.table([table.column("part")[:1], pa.array([level.tobytes()], pa.binary())], ["part", "block"])

    names = ["doc", "n", "lo", "hi", "part", "block"]
    both = materialise(docs.select("doc", "text").mapInArrow(sign, "doc long, n long, lo long, hi long, part int, block binary"), "shingle-signs")
    rows = both.where("part IS NOT NULL").select("part", "block").groupBy("part").applyInArrow(add, "part int, block binary").collect()
    blocks = {r.part: np.frombuffer(r.block, dtype=np.uint8).reshape(2, -1) for r in rows}
    sketch = np.concatenate([blocks[k] for k in range(PARTS)], axis=1) if rows else np.zeros((2, CELLS), dtype=np.uint8)
    return both.where("part IS NULL").select("doc", "n", "lo", "hi"), sketch


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & U(CELLS - 1)).astype(np.int64), (h >> U(44)).astype(np.int64)


def _levels(sketch: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _cells(h)
    return np.minimum(sketch[0][a], sketch[1][b]).astype(np.int64)


def _multi_prefix(h, of, level, percent, base, step):
    """Positions of the shingles of the prefixes, in order of (level, hash) by text, and the texts."""
    n = np.diff(of)
    text = np.repeat(np.arange(len(n)), n)
    order = np.argsort(text * 256 + level, kind="stable")  # h is in order within a text
    least = -(-n * percent // 100)  # of the overlap with any partner
    # candidates that a prefix of l = 1 is thought to bring: the sum of its shingles' frequencies
    rank = np.arange(len(h)) - of[:-1][text]
    first = rank <= (n - least)[text]
    cost = np.bincount(text[first], weights=2.0 ** (level[order][first] / 4.0), minlength=len(n)) / np.maximum(n - least + 1, 1)
    share = base + step * np.log2(np.maximum(cost, 1))
    l = np.clip(np.ceil(share * n).astype(np.int64), 1, np.maximum(least, 1))
    keep = rank < (n - least + l)[text]
    return order[keep], text[keep]


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """One row for each of docs: id, n_shingles, component_id: the smallest id reachable by links, itself included.

    Words are runs of bytes other than blanks, A-Z lower-cased; a set is of the distinct runs of size words, or, of fewer words, of all as one.
    Two documents link when 100 * shared >= percent * united. Texts without words, or null, have 0 shingles and no links.
    Rows with the same id and other texts are one document in links. A null id has n_shingles and a null component. Empty table: empty.

    1. Documents with equal sets are one class, by a 128-bit fingerprint; the rest is done with one of each. The same pass
       gives a sketch of a fixed size of the shingles' frequencies.
    2. The sketch gives an order; each class sends its multi-match prefix (rows of numpy blocks) into buckets by shingle.
       Shingles that several classes of a task have are counted there, and one of them goes on. Shingles of one class are left out.
    3. A class with too few shared shingles in its prefix for any partner goes. Of the others whole sets are fetched, and
       classes with fewer shared shingles than a link needs go too.
    4. With exact frequencies of what is left, new prefixes give the candidates. First each is verified against the
       first of its shingle, which joins most of a group of copies by as many pairs as it has members; then, for
       classes that are still apart, all pairs with the shared shingles that the smaller l asks for are. Documents of
       crowded shingles are compared in blocks instead, each set against all of its home at once.

    Shingles that the sketch takes for frequent are summed before they move and their rows dealt out in parts; so
    are the rows of a class or a hub with many.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    keyed, sketch = signatures(texts, size)
    classes = materialise(keyed.where("n > 0 AND doc IS NOT NULL").groupBy("lo", "hi", "n").agg(F.min("doc").alias("first")), "shingle-classes")
    links = _links(texts.where("doc IS NOT NULL"), keyed, classes, sketch, size, percent, bucket_bytes)
    joined = components(links, "shingle-components")
    placed = classes.join(joined.withColumnRenamed("node", "first"), "first", "left").select("lo", "hi", "n", F.coalesce("component", "first").alias("component"))
    # a document with several rows joins their classes
    rows = spread_join(keyed, placed, ["lo", "hi", "n"], "doc").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    rows = materialise(rows, "shingle-rows")
    split = materialise(rows.where("doc IS NOT NULL").groupBy("doc").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high"), "shingle-split")
    if not split.isEmpty():
        ends = rows.join(split, "doc").select(F.col("low").alias("a"), F.col("component").alias("b"))
        again = components(ends, "shingle-again").toDF("component", "smaller")
        rows = spread_join(rows, again, ["component"], "doc").withColumn("component", F.coalesce("smaller", "component"))
    return rows.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.col("component")).alias("component_id"))


def _by_shingle(rows: DataFrame, **sums: Column) -> DataFrame:
    """rows (shingle, parts, doc, ...) with aggregates over the rows of each shingle.

    Those of a frequent one, which has several parts, are summed before they move; the sums go to each part, where a window
    hands them to the part's rows.
    """
    over = Window.partitionBy("shingle")
    rare = rows.where("parts = 1").select("*", *[x.over(over).alias(k) for k, x in sums.items()])
    many = rows.where("parts > 1").withColumn("_part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    totals = many.groupBy("shingle", "parts").agg(F.struct(*[x.alias(k) for k, x in sums.items()]).alias("_sums")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = many.unionByName(totals, allowMissingColumns=True).withColumn("_sums", F.max("_sums").over(Window.partitionBy("shingle", "_part")))
    return rare.unionByName(both.where("doc IS NOT NULL").select(*rows.columns, "_sums.*"))


def _live_classes(texts: DataFrame, classes: DataFrame, sketch, size: int, percent: int, buckets: int) -> DataFrame:
    """doc: the first of each class with enough shared shingles in its prefix for some partner. Too many may be given, none is left out."""

    def settled(prints: list, owners: list) -> pa.RecordBatch:
        """Blocks (bucket, kind, keys, values): kind 0 are shingles with the class that has them, or 0 for several that are counted; kind 1 classes with counts."""
        p, c = np.concatenate(prints), np.concatenate(owners)
        order = np.lexsort((c, p))
        p, c = p[order], c[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (c[1:] != c[:-1])]) if len(p) else np.zeros(0, dtype=bool)
        p, c = p[new], c[new]
        first = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.zeros(0, dtype=bool)
        alone = first & np.concatenate([first[1:], [True]]) if len(p) else first
        own, n = np.unique(c[~alone], return_counts=True)
        rows = []
        for kind, keys, values, to in ((0, p[first], np.where(alone, c, U(0))[first], p[first]), (1, own, n.astype(U), mixed(own))):
            bucket = (to % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, values, bucket = keys[order], values[order], bucket[order]
            # the bucket and 32 more bits tell shingles apart well enough to leave some out
            keys = (keys >> U(32)).astype(np.uint32) if kind == 0 else keys
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows += [(k, kind, keys[cut[k] : cut[k + 1]].tobytes(), values[cut[k] : cut[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cut))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "keys", "values"])

    def postings(batches):
        prints, owners, held = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=U)], 0
        for batch in batches:
            for _, h, of in _sets(batch, size):
                at, text = _multi_prefix(h, of, _levels(sketch.value, h), percent, 0.1, 0.005)
                with np.errstate(over="ignore"):
                    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(mixed(h ^ U(0x51)))])
                    own = mixed(sums[of[1:]] - sums[of[:-1]] + np.diff(of).astype(U))
                prints.append(mixed(h[at]))
                owners.append(own[text])
                held += len(at)
                if held >= HELD:
                    yield settled(prints, owners)
                    prints, owners, held = prints[:1], owners[:1], 0
        yield settled(prints, owners)

    sums = -(-buckets // 16)

    def joined(table: pa.Table, kind: int, types: tuple) -> list[np.ndarray]:
        mine = [k for k, x in enumerate(table.column("kind").to_pylist()) if x == kind]
        return [np.concatenate([np.zeros(0, dtype=t), *[np.frombuffer(table.column(c)[k].as_buffer(), dtype=t) for k in mine]]) for c, t in zip(("keys", "values"), types, strict=True)]

    def shared_shingles(table: pa.Table) -> pa.Table:
        """How many shingles of its prefix, of those in this bucket, a class has in common with others; packed by where they are summed."""
        prints, owners = joined(table, 0, (np.uint32, U))
        order = np.lexsort((owners, prints))
        prints, owners = prints[order], owners[order]
        new = np.concatenate([[True], (prints[1:] != prints[:-1]) | (owners[1:] != owners[:-1])]) if len(prints) else np.zeros(0, dtype=bool)
        prints, owners = prints[new], owners[new]
        same = prints[1:] == prints[:-1]
        met = owners[(np.concatenate([same, [False]]) | np.concatenate([[False], same]))] if len(prints) else owners
        known, given = joined(table, 1, (U, U))
        own, of = np.unique(np.concatenate([met[met > 0], known]), return_inverse=True)
        count = np.bincount(of, weights=np.concatenate([np.ones(int((met > 0).sum())), given.astype(np.float64)]), minlength=len(own)).astype(np.int64)
        to = (mixed(own) % U(sums)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        own, count, to = own[order], count[order], to[order]
        cut = np.searchsorted(to, np.arange(sums + 1))
        used = np.flatnonzero(np.diff(cut))
        block = lambda x: pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in used], pa.binary())
        return pa.table([pa.array(used, pa.int32()), block(own), block(count)], ["part", "owners", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        owners, counts = (np.concatenate([np.frombuffer(b.as_buffer(), dtype=np.int64) for b in table.column(c)]) for c in ("owners", "counts"))
        own, of = np.unique(owners, return_inverse=True)
        return pa.table([pa.array(own), pa.array(np.bincount(of, weights=counts).astype(np.int64))], ["lo", "shared"])

    by_bucket = texts.mapInArrow(postings, "bucket int, kind int, keys binary, values binary").groupBy("bucket").applyInArrow(shared_shingles, "part int, owners binary, counts binary")
    counted = by_bucket.groupBy("part").applyInArrow(summed, "lo long, shared long").join(classes, "lo")
    # l is 0.1 n at least, and a partner's n is percent of this one's at least
    live = counted.where(F.col("shared") >= F.greatest(F.lit(1), F.ceil(F.col("n") * (percent / 100 * 0.1) - 1e-9)))
    return materialise(live.select(F.col("first").alias("doc")).distinct(), "shingle-live")


def _whole_sets(texts: DataFrame, keyed: DataFrame, live: DataFrame, sketch, limit: int, size: int) -> DataFrame:
    """(doc, n, shingle, parts) of the live documents, each shingle once. A shingle that the sketch gives limit texts or more has parts of a quarter of limit."""

    def sets_of(batches):
        for batch in batches:
            for own, h, of in _sets(batch, size):
                n, texts = np.diff(of), 2.0 ** (_levels(sketch.value, h) / 4)
                columns = (np.repeat(own, n), np.repeat(n, n), h.view(np.int64), np.where(texts < limit, 1, np.ceil(4 * texts / limit)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "n", "shingle", "parts"])

    sets = materialise(texts.join(live, "doc").mapInArrow(sets_of, "doc long, n long, shingle long, parts long"), "shingle-sets")
    several = materialise(keyed.where("n > 0").groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc").join(live, "doc"), "shingle-several")
    if several.isEmpty():
        return sets
    # the rows of one id are one set
    both = sets.join(several, "doc").select("doc", "shingle", "parts").distinct().withColumn("n", F.count("*").over(Window.partitionBy("doc")))
    return materialise(sets.join(several, "doc", "left_anti").unionByName(both), "shingle-sets")


def _links(texts: DataFrame, keyed: DataFrame, classes: DataFrame, sketch: np.ndarray, size: int, percent: int, bucket_bytes: int) -> DataFrame:
    spark = texts.sparkSession
    some = keyed.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-some * 8 // bucket_bytes))
    shared = spark.sparkContext.broadcast(sketch)
    live = _live_classes(texts, classes, shared, size, percent, buckets)
    sets = _whole_sets(texts, keyed, live, shared, max(HOT, some >> 15), size)
    of_doc = Window.partitionBy("doc")
    for _ in range(ROUNDS):
        held = _by_shingle(sets, df=F.count("*")).where("df > 1").drop("df").withColumn("can", F.count("*").over(of_doc))
        kept = materialise(held.where(F.col("can") * 100 >= F.col("n") * percent).drop("can"), "shingle-sets")
        discard(sets)
        sets = kept
    least = F.ceil(F.col("n") * percent / 100)
    # shingles of one class alone stand first in the order; the rounds have left most of them out
    ranked = _by_shingle(sets, df=F.count("*")).withColumns({"can": F.count_if(F.col("df") > 1).over(of_doc), "rows": F.count("*").over(of_doc), "cost": F.log2(F.avg("df").over(of_doc))}).where(F.col("can") >= least)
    rank = F.row_number().over(of_doc.orderBy("df", "shingle")) + F.col("n") - F.col("rows")
    l = F.greatest(F.lit(1), F.least(least, F.ceil(F.col("n") * 0.02 * F.col("cost"))))
    ranked = ranked.withColumns({"rank": rank, "l": l})
    inside = (F.col("df") > 1) & (F.col("rank") <= F.col("n") - least + F.col("l"))
    whole = ranked.groupBy("doc").agg(*[F.min(c).alias(c) for c in ("n", "can", "l")], F.sort_array(F.collect_list("shingle")).alias("set"), F.collect_list(F.when(inside, F.struct("shingle", "parts"))).alias("prefix"))
    whole = materialise(whole, "shingle-arrays")
    discard(sets)
    arrays = whole.select("doc", "set", "n")
    prefix = whole.select("doc", "n", "can", "l", F.explode("prefix").alias("p")).select("doc", "n", "can", "l", "p.shingle", "p.parts")

    hub = F.min(F.struct(F.xxhash64("doc").alias("h"), F.col("doc").alias("hub")))
    pairs = _by_shingle(prefix, m=hub).select("doc", F.col("m.hub").alias("hub")).where("doc <> hub").distinct()
    known = materialise(_verified(pairs, arrays, percent), "shingle-links")
    part = components(known, "shingle-hubs")
    apart = prefix.join(part.toDF("doc", "part"), "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    several = _by_shingle(apart, p=F.min("part"), q=F.max("part"), low=F.min("n")).where("p < q")
    # the smallest partner that a shingle has bounds what its can has to be
    open_ = several.where(F.col("can") * (100 + percent) >= (F.col("n") + F.col("low")) * percent)
    open_ = materialise(open_.select("shingle", "parts", "doc", "n", "can", "l", "part"), "shingle-open")
    crowded = _by_shingle(open_, m=F.count("*"), low=hub).where(F.col("m") >= CROWD)
    homes = materialise(crowded.groupBy("doc").agg(F.max_by("low.hub", F.struct("m", "shingle")).alias("home")), "shingle-homes")
    # each of its shingles has fewer than CROWD documents
    calm = open_.join(homes.select("doc"), "doc", "left_anti")
    x, y = calm.alias("x"), calm.alias("y")
    fits = (F.least("x.can", "y.can") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.part") != F.col("y.part")) & fits)
    met = met.groupBy(F.col("x.doc").alias("doc"), F.col("y.doc").alias("hub")).agg(F.count("*").alias("met"), F.min(F.least("x.l", "y.l")).alias("l")).where("met >= l").select("doc", "hub")
    more = materialise(_verified(met, arrays, percent), "shingle-links")
    return known.unionByName(more).unionByName(_crowd_links(open_, homes, arrays, percent))


def _crowd_links(open_: DataFrame, homes: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Links of the documents with a home, the hub of the most crowded of their shingles.

    Whoever shares a shingle of a prefix with a document of a home comes to the home. There whole sets are compared block
    by block, so a document goes to a few homes and to each once for each block, however many shingles and partners it has.
    Of the links found in a pair of blocks those go out that join its parts.
    """
    reach = open_.join(homes, "doc").select("shingle", "parts", "home").distinct()
    reach = reach.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    came = open_.select("shingle", "doc", F.pmod(F.xxhash64("doc"), F.col("parts")).alias("part"))
    guests = materialise(came.join(reach, ["shingle", "part"]).select("home", "doc").distinct(), "shingle-guests")
    blocks = guests.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    parts = open_.select("doc", "part").distinct()
    rows = spread_join(guests, blocks, ["home"], "doc").join(parts, "doc").join(homes.select("doc", F.col("home").alias("own")), "doc", "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("core", F.coalesce(F.col("own") == F.col("home"), F.lit(False)))
    # documents of the home are one side, all guests, themselves too, the other
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = rows.where("core").select("home", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("left"), "doc", "part")
    right = rows.select("home", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"), "doc", "part")
    cells = left.unionByName(right).join(arrays, "doc")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, doc, part, n = (table.column(c).to_numpy() for c in ("left", "doc", "part", "n"))
        out_a, out_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        core, guest = np.flatnonzero(side), np.flatnonzero(~side)
        if len(core) and len(guest) and len(np.unique(part)) > 1:
            sets = table.column("set").chunk(0)
            shared = _shared_counts(sets.take(pa.array(core)), sets.take(pa.array(guest)))
            size = n[core][:, None] + n[guest][None, :]
            link = (shared * 100 >= (size - shared) * percent) & (part[core][:, None] != part[guest][None, :])
            a, b = np.nonzero(link)
            _, first = np.unique(np.stack([part[core][a], part[guest][b]]), axis=1, return_index=True)
            a, b = core[a[first]], guest[b[first]]
            use = _joining(part[a], part[b])
            out_a.append(doc[a[use]])
            out_b.append(doc[b[use]])
        return pa.table([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return materialise(cells.groupBy("home", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "shingle-links")


def _joining(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges that join what those before them left apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    use = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            use.append(k)
    return np.array(use, dtype=np.int64)


def _shared_counts(left: pa.ListArray, right: pa.ListArray, width: int = 4096) -> np.ndarray:
    """How many values each set of left shares with each of right, by products of tables of which set has which value."""
    owner = lambda x: np.repeat(np.arange(len(x)), x.value_lengths().to_numpy(zero_copy_only=False))
    a, b = left.flatten().to_numpy(zero_copy_only=False), right.flatten().to_numpy(zero_copy_only=False)
    both = np.intersect1d(a, b)
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for k in range(0, len(both), width):
        some = both[k : k + width]
        tables = []
        for values, of, rows in ((a, owner(left), len(left)), (b, owner(right), len(right))):
            at = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[at] == values
            one = np.zeros((rows, len(some)), dtype=np.float32)
            one[of[hit], at[hit]] = 1
            tables.append(one)
        total += tables[0] @ tables[1].T
    return np.rint(total).astype(np.int64)


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (doc, hub) whose sets are similar enough. Shingles of one set only count in n and not in set. A hub may have many pairs."""
    x, y = arrays.toDF("doc", "set_a", "n_a"), arrays.toDF("hub", "set_b", "n_b")

    def keep(batches):
        for batch in batches:
            n = batch.column("n_a").to_numpy(zero_copy_only=False) + batch.column("n_b").to_numpy(zero_copy_only=False)
            shared = np.array([len(np.intersect1d(p.values.to_numpy(), q.values.to_numpy(), assume_unique=True)) for p, q in zip(batch.column("set_a"), batch.column("set_b"), strict=True)], dtype=np.int64)
            ok = pa.array(shared * 100 >= (n - shared) * percent)
            yield pa.RecordBatch.from_arrays([batch.column("doc").filter(ok), batch.column("hub").filter(ok)], ["a", "b"])

    pairs = materialise(pairs, "shingle-pairs")
    both = spread_join(pairs, y, ["hub"], "doc", "inner").join(x, "doc")
    return both.select("doc", "hub", "set_a", "set_b", "n_a", "n_b").mapInArrow(keep, "a long, b long")
