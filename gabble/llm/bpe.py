"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside the tasks.

Each task splits its texts with the tokenizer's pattern and holds the distinct pieces. Their bytes become
token-position rows. A recursive query joins neighbouring tokens with the merge table, contracts each piece's
leftmost pair of least rank, and stops when no pair of any piece is in the table. Ordered aggregation of the
rows gives the ids of a piece, and, for decoding, the bytes of runs of ids from theirs.

Words repeat, so both ways work on distinct ones: a text is cut at its spaces, its ids before the tokens that
open with a space (a run), and Arrow's dictionary encoding deals the results back to the places of the text.

The merge table holds every pair of tokens whose joined bytes are a token, ranked by it; a piece that is a token
is that token. Pieces over ``LONG`` bytes contract all pairs of least rank that don't overlap in one step, from
the left: the same result (a new pair ranks above the pair it came from), in as many steps as there are
different merges, a few steps a query, so that memory stays in proportion to the piece.

Edge cases: a null or empty text has no ids and decodes to nothing; equal texts give equal ids; rows are
independent, repeated ones too; special tokens are ordinary text; other columns are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gabble.llm.common import chunks, text_of

LONG = 48
#: Bytes in one query, distinct words that a task remembers, ids decoded in one query.
QUERY_BYTES = 400_000
REMEMBERED = 400_000
QUERY_IDS = 1_000_000
LONG_STEPS = 8

_SHORT_SQL = """
WITH RECURSIVE s AS (
  SELECT 0::SMALLINT AS step, i.piece, i.pos, i.token, i.pos + 1 AS nxt, n.token AS follower, m.rank
  FROM start i LEFT JOIN start n ON n.piece = i.piece AND n.pos = i.pos + 1
  LEFT JOIN merges m ON m.pair = i.token::BIGINT << 32 | n.token
  UNION ALL
  SELECT u.step, u.piece, u.pos, u.token, u.nxt, u.follower, CASE WHEN u.touched THEN m.rank ELSE u.rank END
  FROM (
    SELECT s.step + 1 AS step, s.piece, s.pos,
      CASE WHEN s.pos = h.pos THEN h.rank ELSE s.token END AS token,
      CASE WHEN s.pos = h.pos THEN h.nxt ELSE s.nxt END AS nxt,
      CASE WHEN s.pos = h.pos THEN h.follower WHEN s.nxt = h.pos THEN h.rank ELSE s.follower END AS follower,
      s.rank, s.pos = h.pos OR s.nxt = h.pos AS touched
    FROM s JOIN (
      SELECT b.piece, (b.least & 65535)::INTEGER AS pos, (b.least >> 16)::INTEGER AS rank, b.gone, g.nxt, g.follower
      FROM (SELECT piece, min(rank::BIGINT << 16 | pos) AS least, arg_min(nxt, rank::BIGINT << 16 | pos) AS gone
            FROM s WHERE rank IS NOT NULL GROUP BY piece) b
      JOIN s g ON g.piece = b.piece AND g.pos = b.gone) h ON s.piece = h.piece
    WHERE s.pos <> h.gone) u
  LEFT JOIN merges m ON m.pair = CASE WHEN u.touched THEN u.token::BIGINT << 32 | u.follower END),
fixed AS (SELECT piece, max(step) AS step FROM s WHERE pos = 0 GROUP BY piece)
SELECT piece, list(token ORDER BY pos) AS ids FROM s JOIN fixed USING (piece, step) GROUP BY piece ORDER BY piece
"""

_LONG_SQL = f"""
WITH RECURSIVE s AS (
  SELECT 0 AS step, piece, pos, token FROM start
  UNION ALL
  SELECT step + 1, piece, pos, CASE WHEN taken THEN least ELSE token END
  FROM (
    SELECT *, lag(taken, 1, false) OVER (PARTITION BY piece ORDER BY pos) AS gone
    FROM (
      SELECT *, hit AND row_number() OVER (PARTITION BY piece, hit, place - place_of_kind ORDER BY pos) % 2 = 1 AS taken
      FROM (
        SELECT *, row_number() OVER (PARTITION BY piece ORDER BY pos) AS place,
          row_number() OVER (PARTITION BY piece, hit ORDER BY pos) AS place_of_kind
        FROM (
          SELECT *, coalesce(rank = least, false) AS hit
          FROM (
            SELECT n.*, m.rank, min(m.rank) OVER (PARTITION BY piece) AS least
            FROM (SELECT *, lead(token) OVER (PARTITION BY piece ORDER BY pos) AS follower FROM s) n
            LEFT JOIN merges m ON m.pair = n.token::BIGINT << 32 | n.follower)
          WHERE least IS NOT NULL AND step < {LONG_STEPS}))))
  WHERE NOT gone)
SELECT piece, list(token ORDER BY pos) AS ids, any_value(last) AS last
FROM (SELECT piece, pos, token, step, max(step) OVER (PARTITION BY piece) AS last FROM s)
WHERE step = last GROUP BY piece ORDER BY piece
"""

_DECODE_SQL = """
SELECT string_agg(v.hex, '' ORDER BY i.pos) AS hex FROM ids i JOIN vocabulary v ON v.id = i.id
"""

#: A space between white space, or between it and the end, joins it in one piece. Other spaces open a piece.
_JOINED_SPACE = re.compile(r"\s (?:\s|$)")
_OPENING_SPACE = re.compile(r"(?<!\s) | (?=\S)")


class Codec:
    """Encodes and decodes with one rank file; one per worker process."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.names = pa.array([b"%d " % i for i in range(max(ranks.values()) + 1)], pa.large_binary())
        self.opens, self.sizes = np.zeros(len(self.names) + 1, bool), np.zeros(len(self.names) + 1, np.int64)
        for token, rank in ranks.items():
            self.opens[rank], self.sizes[rank] = token.startswith(b" "), len(token)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": tempfile.gettempdir()})
        self._fill("merges", pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()),
                                       "rank": pa.array([r for _, r in pairs], pa.int32())}))
        self._fill("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()),
                                           "hex": [t.hex() for t in ranks]}))

    def _fill(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, rows)
        found = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return found

    def _contract(self, tokens: list[np.ndarray] | list[bytes], sql: str) -> pa.Table:
        """Token-position rows of ids, or of raw bytes, contracted by a query."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        if isinstance(tokens[0], bytes):
            joined = self.bytes[np.frombuffer(b"".join(tokens), np.uint8)]
        else:
            joined = np.concatenate(tokens)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self._query("start", pa.table({
            "piece": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes),
            "pos": (np.arange(len(joined)) - starts).astype(np.int32), "token": joined}), sql)

    def pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece of the pattern."""
        out: list = [None] * len(pieces)
        short, long = [], []
        for i, piece in enumerate(pieces):
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            else:
                (short if len(raw) <= LONG else long).append((i, raw))
        for a, b in chunks((len(t) for _, t in short), QUERY_BYTES):
            ids = self._contract([t for _, t in short[a:b]], _SHORT_SQL).column("ids")
            for (i, _), found in zip(short[a:b], _lists(ids)):
                out[i] = found
        while long:
            left = []
            for a, b in chunks((len(t) for _, t in long), QUERY_BYTES // 4):
                found = self._contract([t for _, t in long[a:b]], _LONG_SQL)
                for (i, _), ids, last in zip(long[a:b], _lists(found.column("ids")), found.column("last").to_pylist()):
                    out[i] = ids
                    if last == LONG_STEPS:
                        left.append((i, ids))
            long = left
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Words between spaces are met again: distinct ones are encoded, and remembered."""
        if not texts:
            return []
        if any(map(_JOINED_SPACE.search, texts)):
            parts = pa.array([(_OPENING_SPACE.split(t) if _JOINED_SPACE.search(t) else t.split(" ")) for t in texts],
                             pa.list_(pa.string()))
        else:
            parts = pa.compute.split_pattern(pa.array(texts, pa.string()), " ")
        ends, parts = parts.offsets.to_numpy(), parts.flatten()
        first = np.zeros(len(parts), bool)
        first[ends[:-1]] = True
        rest = parts.filter(pa.array(~first)).dictionary_encode()
        words = [" " + w for w in rest.dictionary.to_numpy(zero_copy_only=False).tolist()]
        places = np.empty(len(parts), np.int32)
        places[~first] = rest.indices.to_numpy()
        places[first] = np.arange(len(words), len(words) + len(texts))
        found = self.words(words + parts.filter(pa.array(first)).to_pylist())
        data, bounds = _spread(pa.array(found, pa.large_binary()), pa.array(places))
        ids, bounds = np.frombuffer(data, np.int32), (bounds[ends] // 4).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words, as bytes: of the remembered, and of the others piece by piece."""
        known = self.new
        unknown = self._missing(w for w in words if w not in known)
        split = [self.pattern.findall(u) for u in unknown]
        # A piece on its own is split into itself, so it is remembered like a word.
        distinct = self._missing(p for w in split for p in w if p not in known)
        known.update(zip(distinct, [x.tobytes() for x in self.pieces(distinct)]))
        for u, w in zip(unknown, split):
            if len(w) != 1:
                known[u] = b"".join([known[p] for p in w])
        out = list(map(known.__getitem__, words))
        for u, w in zip(unknown, split):
            # Lines without spaces are long and seldom repeat; their pieces are remembered.
            if len(u) > LONG and len(w) > 1:
                del known[u]
        if len(known) > REMEMBERED:
            self.old, self.new = known, {}
        return out

    def _missing(self, parts) -> list[str]:
        """Distinct parts that are not remembered; those of the older half move to the newer."""
        known, old, out = self.new, self.old, {}
        for p in parts:
            if p in old:
                known[p] = old[p]
            else:
                out[p] = None
        return list(out)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        out: list[bytes] = []
        for a, b in chunks(map(len, ids), QUERY_IDS):
            joined = np.concatenate(ids[a:b])
            ends = np.cumsum([0, *map(len, ids[a:b])])
            cut = np.append(self.opens[self._inside(joined)], True)
            cut[ends] = True
            starts = np.flatnonzero(cut)
            runs = _sliced(joined, starts * 4).dictionary_encode()
            data, bounds = _spread(self.runs(runs.dictionary), runs.indices)
            bounds = bounds[np.searchsorted(starts, ends)].tolist()
            out += [bytes(data[x:y]) for x, y in zip(bounds, bounds[1:])]
        return out

    def runs(self, runs: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The bytes of runs of ids."""
        data, bounds = _content(runs)
        ids = np.frombuffer(data, np.int32)
        found = self._query("ids", pa.table({"pos": np.arange(len(ids), dtype=np.int32), "id": ids}), _DECODE_SQL)
        ends = np.cumsum(np.append(0, self.sizes[self._inside(ids)]))
        return _sliced(bytes.fromhex(found.column("hex")[0].as_py() or ""), ends[bounds // 4])

    def _inside(self, ids: np.ndarray) -> np.ndarray:
        """Ids, with a place of its own for those beyond the vocabulary, which have no bytes."""
        return np.where((ids >= 0) & (ids < len(self.names)), ids, len(self.names))

    def written(self, ids: list[np.ndarray]) -> list[memoryview]:
        """The decimal ids of each list, joined by one space."""
        data, bounds = _spread(self.names, pa.array(np.concatenate(ids)))
        bounds = bounds[np.cumsum([0, *map(len, ids)])].tolist()
        return [data[a:max(a, b - 1)] for a, b in zip(bounds, bounds[1:])]


def _sliced(data: bytes | np.ndarray, bounds: np.ndarray) -> pa.LargeBinaryArray:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def _content(values: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
    """Values of a fresh array, joined, and their bounds."""
    if not len(values):
        return memoryview(b""), np.zeros(1, np.int64)
    _, bounds, data = values.buffers()
    bounds = np.frombuffer(bounds, np.int64)[:len(values) + 1]
    return memoryview(data or b"")[:bounds[-1]], bounds


def _spread(values: pa.LargeBinaryArray, places: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The values at the places, joined, and their bounds."""
    return _content(values.take(places))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        values, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return out


@lru_cache(maxsize=2)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _texts(column: pa.Array):
    """Runs of texts of bounded size."""
    sizes = pa.compute.binary_length(column).to_pylist()
    for a, b in chunks(sizes, 4_000_000):
        yield a, b, column.slice(a, b - a).to_pylist()


def encode(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: one row per document."""

    def run(batches):
        own = codec(rank_file, pattern)
        for batch in batches:
            for a, b, texts in _texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(own.encode(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, bytes``: one row per list of ids (null: no bytes)."""

    def run(batches):
        own = codec(rank_file, pattern)
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.decode(lists), pa.binary())],
                                             names=["doc_id", "bytes"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids)).mapInArrow(run, f"doc_id {kind}, bytes binary")


def digests(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes, decodes the ids, and keeps digests of both."""

    def run(batches):
        own = codec(rank_file, pattern)
        for batch in batches:
            for a, b, texts in _texts(batch.column(1)):
                ids = own.encode(texts)
                raw = own.decode(ids)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in own.written(ids)]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
