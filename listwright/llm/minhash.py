"""Operator 10: near-duplicate documents by MinHash with tensored banding, every link confirmed on full shingle sets.

Two collections of `COLLECTION` half keys are made of two minhashes each. Every pair of a half key from the one and a
half key from the other is a table, so 4 x COLLECTION minhashes give COLLECTION^2 tables of four minhashes. Two
documents of similarity s share no table only if they agree in no half key of one collection: at s = 0.75 at most
2 x (1 - 0.75^2)^10 = 0.05 %, at 0.85 less than one in 180,000.

1. A scan makes each document's set, its size, a digest of it and its signature. Equal sets are one class.
2. Half keys that only one class has can't link anything and are dropped before tables are formed.
3. In the COLLECTION tables of half keys of one place every class meets its bucket's leader: a bucket of n classes gives
   n - 1 pairs. Links are confirmed on the sets of both, and make components. That joins most of each group.
4. Of all tables' buckets only those go on that hold more than one component. Again each class meets its bucket's
   leader, if that is of another component.
5. All classes of the buckets of 4 meet in an exact join on their rarest shingles (`exact_pairs`), which leaves out no
   similar pair of two components. So leaders only save work: no link between classes that share a table depends on
   them, and there's no bound on rounds, partners or bucket sizes.
6. Components by propagation of the smallest id along links, with a shortcut through each neighbour's own label; links
   of 4 and 5 join the components found before.

Hot groups: a bucket's leader and components come from an aggregation that Spark combines in the tasks; its rows meet
that one row in a join whose sides are read from tables, so that AQE can split it.

Defined results. Documents with a null text, or without words, have an empty set and are linked with nothing. With
fewer words than a shingle has, the whole sequence is the one shingle. Repeated rows of a doc_id are one document each
in the result and linked by their texts, also if these differ. Null doc_ids take part in no component and keep a null
component_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget_others, written
from .features import fresh

WORDS, SIMILARITY = 5, (75, 100)
COLLECTION, HALF = 10, 2
MINHASHES = 2 * COLLECTION * HALF
#: Shingles in a batch of `exact_pairs`; earlier shingles that one of its rows knows, so that a pair is met once.
TOKENS, EARLIER = 200_000, 8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EMPTY = np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit shingle hashes. A word's hash is the first half of its BLAKE2b digest; words are kept in a cache."""

    def __init__(self, width: int = WORDS) -> None:
        self.width, self.known = width, {}

    def word(self, w: bytes) -> int:
        value = self.known.get(w)
        if value is None:
            if len(self.known) > 300_000:
                self.known.clear()
            value = self.known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return value

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes of a whole text."""
        words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
        if not words:
            return EMPTY
        code = np.fromiter(map(self.word, words), np.uint64, len(words))
        width = min(self.width, len(words))
        out = np.full(len(words) - width + 1, len(words) if len(words) < self.width else self.width, np.uint64)
        for i in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + code[i : len(code) - width + 1 + i])
        return np.unique(out)


SEEDS = mixed(np.arange(1, MINHASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def signature(own: np.ndarray) -> np.ndarray:
    """The minhashes of a set, 32 bits each."""
    out = np.full(MINHASHES, 2**32 - 1, np.uint32)
    for low in range(0, len(own), 4096):
        x = own[low : low + 4096, None] * SEEDS
        out = np.minimum(out, ((x ^ (x >> np.uint64(29))) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def half_keys(own: np.ndarray) -> np.ndarray:
    """Keys of both collections; the collection and place of a key are part of it."""
    halves = own.reshape(2 * COLLECTION, HALF).astype(np.uint64)
    return mixed((halves[:, 0] << np.uint64(32) | halves[:, 1]) + mixed(np.arange(1, 2 * COLLECTION + 1, dtype=np.uint64))).astype(np.int64)


def digest_of(own: bytes) -> bytes:
    return hashlib.blake2b(own, digest_size=16).digest()


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key): the key tells apart the texts of a repeated doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))


def text_key(text: Column) -> Column:
    """A number for a text; a null text's differs from an empty one's."""
    return F.xxhash64(text, text.isNull())


def sketched(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, minhashes) of every document; the last two are null for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        make = Shingler(width)
        for batch in batches:
            n, digest, minhashes = [], [], []
            for text in batch.column(1).to_pylist():
                own = make.hashes(text)
                n.append(len(own))
                digest.append(digest_of(own.tobytes()) if len(own) else None)
                minhashes.append(signature(own).tobytes() if len(own) else None)
            cols = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(minhashes, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "n_shingles", "digest", "minhashes"])

    return texts_of(docs).mapInArrow(sketch, "doc_id long, text_key long, n_shingles long, digest binary, minhashes binary")


def classes_of(sketches: DataFrame) -> DataFrame:
    """(id, doc_id, text_key, digest, n, minhashes): each distinct set once, with the first of its documents."""
    own = sketches.where("digest is not null and doc_id is not null").groupBy("digest", "minhashes", F.col("n_shingles").alias("n"))
    own = own.agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.doc_id", "first.text_key", "digest", "n", "minhashes")
    return own.withColumn("id", F.monotonically_increasing_id())


def shared_halves(classes: DataFrame) -> DataFrame:
    """(id, n, a, b): each class's half keys of both collections that another class has too, as (place, half)."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, MINHASHES)
            keys = np.array([half_keys(x) for x in own], np.int64).reshape(-1, 2 * COLLECTION)
            cols = [pa.array(np.repeat(batch.column(i).to_numpy(), 2 * COLLECTION)) for i in (0, 1)]
            cols += [pa.array(np.tile(np.arange(2 * COLLECTION, dtype=np.int32), len(own))), pa.array(keys.ravel())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "place", "half"])

    keys = written(classes.select("id", "n", "minhashes").mapInArrow(halves, "id long, n long, place int, half long"), "minhash-halves")
    shared = written(keys.groupBy("half").agg(F.count("*").alias("of")).where("of > 1").select("half"), "minhash-shared")
    first, own = F.col("place") < COLLECTION, F.struct((F.col("place") % COLLECTION).alias("place"), "half")
    kept = keys.join(shared.hint("merge"), "half").groupBy("id", "n").agg(F.collect_list(F.when(first, own)).alias("a"), F.collect_list(F.when(~first, own)).alias("b"))
    return kept.where((F.size("a") > 0) & (F.size("b") > 0))


def in_tables(rows: DataFrame, same_place: bool) -> DataFrame:
    """The rows with a column key, once for each of their tables; same_place: only tables of half keys of one place."""
    every = rows.withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))
    if same_place:
        every = every.where("a.place = b.place")
    return every.withColumn("key", F.xxhash64("a.half", "b.half")).drop("a", "b")


def with_leaders(keys: DataFrame, seed: int) -> DataFrame:
    """(id, n, component, leader, of_leader, n_leader) of all rows of buckets that hold several components.

    keys is (key, id, n, component). Each bucket has a leader of its own, the class of smallest hash.
    """
    order = F.xxhash64(F.lit(seed), "key", "id")
    heads = keys.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.min(F.struct(order.alias("order"), F.col("id").alias("leader"), F.col("component").alias("of_leader"), F.col("n").alias("n_leader"))).alias("first")
    )
    heads = written(heads.where("least < most").select("key", "first.leader", "first.of_leader", "first.n_leader"), "minhash-leaders")
    return keys.join(heads.hint("merge"), "key").select("id", "n", "component", "leader", "of_leader", "n_leader")


def led_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of classes and their leaders of other components, unless their sizes rule the similarity out."""
    ratio = F.least("n", "n_leader") * SIMILARITY[1] >= F.greatest("n", "n_leader") * SIMILARITY[0]
    return rows.where(F.col("component") != F.col("of_leader")).where(ratio).select(F.least("id", "leader").alias("x"), F.greatest("id", "leader").alias("y")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough; sets is (id, hashes binary)."""
    left = sets.select(F.col("id").alias("x"), F.col("hashes").alias("of_x"))
    right = sets.select(F.col("id").alias("y"), F.col("hashes").alias("of_y"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared * SIMILARITY[1] >= (len(a) + len(b) - shared) * SIMILARITY[0])
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    rows = pairs.join(left.hint("merge"), "x").join(right.hint("merge"), "y").select("x", "y", "of_x", "of_y")
    return rows.mapInArrow(similar, "x long, y long")


def shingle_sets(docs: DataFrame, classes: DataFrame, width: int = WORDS) -> DataFrame:
    """(id, hashes) of the classes (id, doc_id, text_key), one row for each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(width)
        for batch in batches:
            own = [make.hashes(x).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["id", "hashes"])

    own = classes.select("id", "doc_id", "text_key").join(texts_of(docs).hint("merge"), ["doc_id", "text_key"]).select("id", "text")
    return own.mapInArrow(sets, "id long, hashes binary").dropDuplicates(["id"])


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches.

    A round gives each id the smallest label among its own, its neighbours' and its label's own label, so paths shrink
    at least as fast as they double. Labels are written each round; the driver sees one count.
    """
    edges = written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "minhash-edges")
    labels = written(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("id"), "label"), "minhash-labels")
    while True:
        of_y = labels.select(F.col("id").alias("y"), F.col("label").alias("near"))
        near = edges.join(of_y.hint("merge"), "y").groupBy("x").agg(F.min("near").alias("near"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = labels.join(near.withColumnRenamed("x", "id").hint("merge"), "id").join(jump.hint("merge"), "label", "left")
        new = moved.select("id", F.least("label", "near", "next").alias("label"), (F.least("label", "near", "next") < F.col("label")).alias("changed"))
        new = written(new, "minhash-labels")
        labels = new.select("id", "label")
        if new.where("changed").isEmpty():
            return labels.withColumnRenamed("label", "component")


def joined(found: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The components `found` (id, component), joined by those of the pairs whose sets are similar."""
    links = written(confirmed(pairs, sets), "minhash-links")
    if links.isEmpty():
        return found
    for end in ("x", "y"):
        of = found.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
        links = links.join(of.hint("merge"), end)
    merged = components(links.where("of_x <> of_y").select(F.col("of_x").alias("x"), F.col("of_y").alias("y")))
    merged = merged.select(F.col("id").alias("component"), F.col("component").alias("into"))
    return written(found.join(merged.hint("merge"), "component", "left").select("id", F.coalesce("into", "component").alias("component")), "minhash-components")


def exact_pairs(ids: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (x, y) of the classes `ids`, among them all similar ones of two components.

    Shingles are ordered by the number of classes that have them, those of one component only before all others. Sets
    of n and m shingles that are similar share one among the first n - ceil(0.75 n) + 1 of the one and so of the other;
    the first that they share also leaves enough behind it for the least overlap. A passage that unlike classes share
    is frequent, comes late and gives no pair. The rows of each shingle's largest component only meet rows of others, so
    that a component of very many classes isn't compared with itself. A row knows some of the shingles before its own:
    where both rows have one of them, the pair has been met there.
    """
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    of = found.join(sizes.hint("merge"), "component").join(ids.hint("merge"), "id").select("id", F.struct("size", "component").alias("of"))
    of = of.join(sets.hint("merge"), "id").select("id", "of.size", "of.component", "hashes")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) // 8 for x in batch.column(3).to_pylist()], np.int64)
            part = np.cumsum(size) // TOKENS
            for k in np.unique(part):
                at = np.flatnonzero(part == k)
                own = batch.slice(at[0], len(at))
                cols = [pa.array(np.repeat(own.column(i).to_numpy(), size[at])) for i in (0, 1, 2)]
                token = np.frombuffer(b"".join(own.column(3).to_pylist()), np.int64)
                cols += [pa.array(np.repeat(size[at], size[at])), pa.array(token)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "size", "component", "n", "token"])

    every = written(of.mapInArrow(tokens, "id long, size long, component long, n long, token long"), "minhash-tokens")
    several = every.groupBy("token").agg(F.count("*").alias("many"), F.min("component").alias("a"), F.max("component").alias("b"), F.max(F.struct("size", "component")).alias("main"))
    several = written(several.where("a < b").select("token", "many", F.col("main.component").alias("main")), "minhash-several")
    own = every.join(several.hint("merge"), "token").groupBy("id", "component", "n")
    own = own.agg(F.sort_array(F.collect_list(F.struct("many", "token", (F.col("component") == F.col("main")).alias("main")))).alias("own"))
    own = own.withColumn("alone", F.col("n") - F.size("own"))
    own = own.withColumn("first", F.expr(f"n - (n * {SIMILARITY[0]} + {SIMILARITY[1] - 1}) div {SIMILARITY[1]} + 1 - alone")).where("first > 0")
    rows = own.select("id", "component", "n", "alone", F.col("own.token").alias("tokens"), F.posexplode(F.slice("own", F.lit(1), F.col("first").cast("int"))))
    earlier = F.expr(f"slice(tokens, greatest(pos - {EARLIER}, 0) + 1, least(pos, {EARLIER}))")
    left = F.col("n") - F.col("alone") - F.col("pos")
    rows = written(rows.select("id", "component", "n", left.alias("left"), "col.token", "col.main", earlier.alias("earlier")), "minhash-first")

    def side(own: DataFrame, end: str) -> DataFrame:
        return own.select("token", *(F.col(c).alias(f"{c}_{end}") for c in ("id", "component", "n", "left", "main", "earlier")))

    enough = F.least("left_x", "left_y") * sum(SIMILARITY) >= (F.col("n_x") + F.col("n_y")) * SIMILARITY[0]
    once = F.col("main_y") | (F.col("id_x") < F.col("id_y"))
    both = side(rows.where("not main"), "x").join(side(rows, "y").hint("merge"), "token")
    both = both.where((F.col("component_x") != F.col("component_y")) & once & enough & ~F.arrays_overlap("earlier_x", "earlier_y"))
    return both.select(F.least("id_x", "id_y").alias("x"), F.greatest("id_x", "id_y").alias("y")).distinct()


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, classes, components of the classes that may have links)."""
    sketches = written(sketched(docs), "minhash-sketches")
    classes = written(classes_of(sketches), "minhash-classes")
    halves = written(shared_halves(classes), "minhash-tables")
    sets = written(shingle_sets(docs, classes.join(halves.select("id").hint("merge"), "id")), "minhash-sets")
    found = halves.select("id", F.col("id").alias("component"))
    keys = in_tables(halves.withColumn("component", F.col("id")), same_place=True)
    found = joined(found, written(led_pairs(with_leaders(keys, 0)), "minhash-pairs"), sets)
    placed = written(halves.join(found.hint("merge"), "id"), "minhash-placed")
    still = written(with_leaders(in_tables(placed, same_place=False), 1), "minhash-open")
    if not still.isEmpty():
        found = joined(found, written(led_pairs(still), "minhash-pairs"), sets)
        found = joined(found, written(exact_pairs(still.select("id").distinct(), sets, found), "minhash-pairs"), sets)
    return sketches, classes, found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    sketches, classes, found = grouped(docs)
    named = written(found.join(classes.select("id", "doc_id", "digest").hint("merge"), "id"), "minhash-named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least.hint("merge"), "component").select("digest", "component_id")
    others = classes.join(found.hint("merge"), "id", "left_anti").select("digest", F.col("doc_id").alias("component_id"))
    of_class = written(of_class.unionByName(others), "minhash-of-class")
    rows = sketches.join(of_class.hint("merge"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents in the same columns, one of each group: that of smallest doc_id (then text_key), whatever is beside it.

    Documents of an empty set are groups of their own; of rows that repeat a doc_id and a text, one stays. Rows with a
    null doc_id stay as they are. Unlike texts of one doc_id are of unlike groups, and stay both.
    """
    sketches, classes, found = grouped(docs)
    every = classes.join(found.hint("merge"), "id", "left").groupBy(F.coalesce("component", "id").alias("component"))
    kept = every.agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.doc_id", "first.text_key")
    kept = kept.unionByName(sketches.where("digest is null and doc_id is not null").select("doc_id", "text_key").distinct())
    own, key = docs.where("doc_id is not null"), fresh(docs.columns, "text_key")
    doc = fresh(docs.columns, "kept_doc_id")
    own = own.withColumn(key, text_key(F.col("text").cast("string"))).withColumn(doc, F.col("doc_id").cast("long"))
    own = own.join(kept.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).hint("merge"), [doc, key], "left_semi").dropDuplicates([doc, key])
    names = [F.col(f"`{c}`") for c in docs.columns]
    return own.select(*names).unionByName(docs.where("doc_id is null").select(*names))
