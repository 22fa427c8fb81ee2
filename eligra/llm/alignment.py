"""Token links between two tokenizers: exact one-to-one groups are counted in vocabulary-length vectors, only others are shuffled as pairs."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligra.llm.common import bound_batches
from eligra.session import materialize

#: Distinct pairs and documents after which a task closes a block.
PAIRS, DOCS = 200_000, 4_000
#: Words whose tokens A remembers; the tokenizer's own 10,000 are soon full.
WORDS = 50_000
#: Tasks that add up vectors, one result each.
ADDERS = 16


def byte_level_bytes(entry: str) -> bytes:
    """The bytes of a byte-level entry: printable Latin-1 characters stand for themselves, the other bytes for U+0100 onwards, in order."""
    return bytes(map(_BYTE_OF.__getitem__, entry))


def _byte_table() -> dict[str, int]:
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_BYTE_OF = _byte_table()


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()


#: After an id of A, the last of A in its group, an id of B, the last of a group.
MARKS = (",", "|", ",", ";")


class Pair:
    """Both tokenizers with the bytes of their entries. Made from the files' content, so that tasks need no path."""

    def __init__(self, level_json: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.level = Tokenizer.from_str(level_json)
        self.level.encode_special_tokens = True
        self.level.no_padding()
        self.level.no_truncation()
        self.level.model._resize_cache(WORDS)
        self.piece = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        special = {t["id"]: t["content"].encode() for t in json.loads(level_json)["added_tokens"]}
        by_id = {i: entry for entry, i in self.level.get_vocab(with_added_tokens=True).items()}
        self.a = [special[i] if i in special else byte_level_bytes(by_id[i]) if i in by_id else b"" for i in range(max(by_id) + 1)]
        self.b = [piece_bytes(self.piece.id_to_piece(i), self.piece.is_byte(i)) for i in range(self.piece.get_piece_size())]
        self.a_size, self.b_size = np.array(list(map(len, self.a))), np.array(list(map(len, self.b)))
        # Of entries with the same bytes the last in this order counts: single-byte fallbacks only where no other entry has them.
        order = sorted(range(len(self.b)), key=lambda i: (not self.piece.is_byte(i), -i))
        same = {self.b[i]: i for i in order if self.b[i]}
        #: The id of B with the same bytes as each id of A, or -1.
        self.identity = np.array([same.get(x, -1) if x else -1 for x in self.a], np.int64)
        #: What stands for an id and its mark in a text's groups, by 4 * id + mark; made when first met.
        self.names: list[bytes | None] = [None] * (4 * max(len(self.a), len(self.b)))
        self.named = np.zeros(len(self.names), bool)

    def name(self, code: np.ndarray) -> None:
        """Make the missing names of ``code``."""
        met = np.zeros(len(self.named), bool)
        met[code] = True
        for c in np.flatnonzero(met & ~self.named).tolist():
            self.names[c] = f"{c >> 2}{MARKS[c & 3]}".encode()
        self.named |= met

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each text; none where their bytes are not a space and the text."""
        left = [e.ids for e in self.level.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]  # ids without offsets
        right = self.piece.encode(texts, num_threads=1)
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            if not t or b"".join(map(self.a.__getitem__, left[k])) != whole or b"".join(map(self.b.__getitem__, right[k])) != whole:
                left[k] = right[k] = []
        return left, right


class Links:
    """Groups and links of a batch of texts, worked out as arrays over all its tokens."""

    def __init__(self, pair: Pair, texts: list[str]):
        self.pair = pair
        left, right = pair.encode(texts)
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
        self.a, self.b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((left, self.n_a), (right, self.n_b)))
        # Marks at the bytes where a token of either side ends; a link is the stretch up to each of them.
        ends = np.zeros((2, int(pair.a_size[self.a].sum()) + 1), bool)
        ends[0][np.cumsum(pair.a_size[self.a])] = True
        ends[1][np.cumsum(pair.b_size[self.b])] = True
        cuts = np.flatnonzero(ends[0] | ends[1])
        in_a, in_b = ends[0][cuts], ends[1][cuts]
        self.of_a, self.of_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        shared = in_a & in_b
        before = np.concatenate([[True], shared[:-1]])[:len(cuts)]
        self.doc = np.repeat(np.arange(len(texts)), self.n_a)[self.of_a] if len(cuts) else np.zeros(0, np.int64)
        count = len(texts)
        self.n_links, self.n_groups = np.bincount(self.doc, minlength=count), np.bincount(self.doc[shared], minlength=count)
        group = np.cumsum(shared) - shared
        self.group_a, self.last_a = self._groups(self.of_a, group)
        self.group_b, self.last_b = self._groups(self.of_b, group)
        alone = shared & before
        self.x, self.y = self.a[self.of_a], self.b[self.of_b]
        #: Links of exact one-to-one groups whose B id the array foretells.
        self.regular = alone & (pair.identity[self.x] == self.y)

    @staticmethod
    def _groups(of: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token, and whether it is the last of its side in the group."""
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        g = group[first]
        return g, np.concatenate([g[1:] != g[:-1], [True]]) if len(g) else np.zeros(0, bool)

    def digests(self) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2`` of each text, '' without tokens: names of A and B ids with their mark, put in place group by group."""
        groups = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        in_a, in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]] = self.a * 4 + self.last_a
        code[np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]] = self.b * 4 + 2 + self.last_b
        self.pair.name(code)
        names, out, at = self.pair.names.__getitem__, [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256(b"".join(map(names, code[at:at + n].tolist()))[:-1]).hexdigest() if n else "")
            at += n
        return out


def _counted(doc: np.ndarray, key: np.ndarray, size: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key), in order, and how often each occurs; ``size``: keys are below it, 0: not known."""
    keys, at = (None, key) if size else np.unique(key, return_inverse=True)
    size = size or max(1, len(keys))
    both, n = np.unique(doc * size + at, return_counts=True)
    return both // size, both % size if keys is None else keys[both % size], n


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(len(a).to_bytes(8, "big") + a.astype(np.int64).tobytes() for a in arrays))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(blob), 0, []
    while at < len(data):
        n = int.from_bytes(data[at:at + 8], "big")
        out.append(np.frombuffer(data, np.int64, n, at + 8))
        at += 8 + 8 * n
    return out


def _linked(files, id_type: pa.DataType):
    """Rows of four kinds: documents (0), links of a batch (1), distinct pairs of a block (2), a task's vector (3)."""
    schema = pa.schema([("kind", pa.int8()), ("block", pa.int64()), ("place", pa.int32()), ("doc_id", id_type), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("n", pa.int64()),
                        ("blob", pa.binary())])

    def rows(n: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if f.name not in columns else
                                           columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else
                                           pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*files.value)
        vector = np.zeros(len(pair.a), np.int64)
        block, place, held, held_rows = TaskContext.get().partitionId() << 32, 0, [], 0

        def close() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)
            return rows(len(keys), kind=np.full(len(keys), 2, np.int8), block=np.full(len(keys), block), pair=keys, n=sums)

        for batch in batches:
            if not batch.num_rows:
                continue
            links = Links(pair, batch.column("text").to_pylist())
            n = batch.num_rows
            yield rows(n, kind=np.zeros(n, np.int8), block=np.full(n, block), place=np.arange(place, place + n, dtype=np.int32), doc_id=batch.column("doc_id"),
                       n_a=links.n_a, n_b=links.n_b, n_groups=links.n_groups, n_links=links.n_links, groups_sha256=links.digests())
            vector += np.bincount(links.x[links.regular], minlength=len(vector))
            other = ~links.regular
            doc_r, a_r, n_r = _counted(links.doc[links.regular] + place, links.x[links.regular], len(pair.a))
            doc_o, key_o, n_o = _counted(links.doc[other] + place, (links.x[other] << 32) | links.y[other])
            yield rows(1, kind=[1], block=[block], blob=[_packed(doc_r, a_r, n_r, doc_o, key_o, n_o)])
            keys, at = np.unique(key_o, return_inverse=True)
            held.append((keys, np.bincount(at, n_o, len(keys)).astype(np.int64)))
            held_rows += len(keys)
            place += n
            if held_rows >= PAIRS or place >= DOCS:
                yield close()
                block, place, held, held_rows = block + 1, 0, [], 0
        if held:
            yield close()
        yield rows(1, kind=[3], blob=[_packed(vector)])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            v = _unpacked(blob)[0]
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_pydict({"blob": pa.array([_packed(total)], pa.binary())})


def _judged(best, regular, identity):
    """Per document of a block: how many links are their B id's most frequent, and the sum of their counts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = left.num_rows
        n_best, count_sum = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        keys = right.column("pair").combine_chunks().drop_null().to_numpy()
        order = np.argsort(keys)
        keys, totals = keys[order], right.column("total").combine_chunks().drop_null().to_numpy()[order]
        for blob in right.column("blob").drop_null().to_pylist():
            doc_r, a, n_r, doc_o, key, n_o = _unpacked(blob)
            count_r, count_o = regular.value[a], totals[np.searchsorted(keys, key)]
            for doc, n, count, b in ((doc_r, n_r, count_r, identity.value[a]), (doc_o, n_o, count_o, key & 0xFFFFFFFF)):
                np.add.at(count_sum, doc, n * count)
                np.add.at(n_best, doc, n * (count == best.value[b]))
        place = left.column("place").to_numpy()
        return left.drop_columns(["place", "block"]).append_column("n_best", pa.array(n_best[place])).append_column("count_sum", pa.array(count_sum[place]))

    return run


def align(docs: DataFrame, level_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level tokenizer that gets a space and the text, B one of pieces that adds the space itself. Tokens fall into
    groups at the byte offsets where both sides end; tokens whose bytes overlap are linked, and a pair of ids counts all its links in the
    corpus. ``n_best`` are links whose count is the highest of their B id, ties included; ``count_sum`` adds the counts over links.
    Null and empty texts, and those that either side does not give back byte for byte, have zeros and an empty digest, and count
    nowhere. Null ids and repeated rows are kept as they are, and each repetition counts. Other columns are not read. An empty table gives no rows.

    Links of one-to-one groups whose B id is the one that has the bytes of the A id are counted in a vector as long as A's vocabulary, one
    a task. All other links become distinct pairs of a block of documents, are summed over the corpus, and their totals return to
    the block: the shuffle grows with blocks times their distinct pairs. What is sent to all tasks is as long as a vocabulary.
    """
    spark = docs.sparkSession
    with open(level_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    pair = Pair(*files.value)
    slim = bound_batches(docs).select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    id_type = slim.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = (f"kind tinyint, block bigint, place int, doc_id {id_type.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
              "groups_sha256 string, pair bigint, n bigint, blob binary")
    all_rows = materialize(slim.mapInArrow(_linked(files, to_arrow_type(id_type)), schema))
    vector = np.zeros(len(pair.a), np.int64)
    for r in all_rows.where("kind = 3").select("blob").repartition(ADDERS).mapInArrow(_added, "blob binary").collect():
        vector += _unpacked(bytes(r.blob))[0]

    known = np.flatnonzero((pair.identity >= 0) & (vector > 0))
    exact = spark.createDataFrame([((int(a) << 32) | int(pair.identity[a]), int(vector[a])) for a in known], "pair bigint, n bigint")
    pairs = all_rows.where("kind = 2").select("block", "pair", "n")
    totals = materialize(pairs.select("pair", "n").unionByName(exact).groupBy("pair").agg(F.sum("n").alias("total")))
    best = np.zeros(len(pair.b), np.int64)
    for r in totals.groupBy((F.col("pair") % (1 << 32)).alias("b")).agg(F.max("total").alias("most")).collect():  # a row a B id
        best[r.b] = r.most
    regular = np.zeros(len(pair.a), np.int64)
    for r in totals.join(F.broadcast(exact.select("pair")), "pair").collect():  # a row an A id at most
        regular[r.pair >> 32] = r.total

    looked_up = pairs.join(totals, "pair").select("block", "pair", "total", F.lit(None).cast("binary").alias("blob"))
    blobs = all_rows.where("kind = 1").select("block", F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("total"), "blob")
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    documents = all_rows.where("kind = 0").select("block", "place", "doc_id", *counts, "groups_sha256")
    send = spark.sparkContext.broadcast
    done = documents.groupBy("block").cogroup(looked_up.unionByName(blobs).withColumnRenamed("block", "of").groupBy("of")).applyInArrow(
        _judged(send(best), send(regular), send(pair.identity)),
        f"doc_id {id_type.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    return done.select("doc_id", *counts, "n_best", "count_sum", "groups_sha256")
