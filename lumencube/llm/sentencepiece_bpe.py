"""Merge-type SentencePiece encoding by a table of last tokens, and decoding.

Encoding the first i characters of a string ends in exactly one token, and what stands before that token is itself
the encoding of a shorter prefix. So a table with the last token of every prefix holds the whole encoding. It is
filled from left to right: an automaton lists the pieces that end at i, and the one piece is the right one that is
compatible with the last token of the prefix before it. Two tokens are compatible when merging the characters of
both gives these two tokens again. Ids are then read backwards from the end.

Pieces of the supported models never cross from a non-space to a space, so a text is encoded piece-wise between such
borders, and what a segment encodes to is remembered within bounds.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, text_batches

SPACE_MARK = "▁"
#: Latin letters, as a character class. Where no piece goes on from one of them to another character, a word ends there.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Token pairs that a worker remembers at most, bytes of the segments of a generation, bytes of each besides its characters.
REMEMBERED, REMEMBERED_BYTES, ENTRY_BYTES = 1 << 16, 28_000_000, 190
#: Longest run of one segment that is remembered; longer ones are encoded each time.
LONG_SEGMENT = 64


class Model:
    """Vocabulary of a merge-type model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, proto: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(proto)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only merge-type models with byte fallback, a dummy prefix and identity normalisation are supported")
        self.pieces = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == 1}
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in self.ids) or any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("pieces that cross into a space, user-defined and unused pieces are not supported")
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == 3}
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        stop = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        letters = LATIN if not any(re.search(f"[{LATIN}][^{LATIN}]", p) for p in self.ids) else ""
        rest = f"[^{SPACE_MARK}{stop}{letters}]"
        word = f"{SPACE_MARK}*{rest}*[{letters}]+|" if letters else ""
        self.segments = re.compile((f"[{stop}]|" if stop else "") + f"{word}{SPACE_MARK}*{rest}+|{SPACE_MARK}+").findall
        self.shown = [str(i) for i in range(len(self.pieces))]
        self.plain = [p.piece if p.type == 1 else None for p in spec.pieces]
        self.sizes = [len(p) for p in self.pieces]
        self.sizes[0] = 1  # <unk> stands for one character without a piece
        self.known = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merged(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.memory = _Memory(self)

    def merged(self, text: str) -> list[str]:
        """Tokens of a short string by merging its best pair again and again; ties go to the left."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both tokens gives these two tokens again."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        found = left == 0 or self.merged(self.pieces[left] + self.pieces[right]) == [self.pieces[left], self.pieces[right]]
        self.pairs[left * len(self.pieces) + right] = found
        return found

    def segment_ids(self, segment: str) -> list[int]:
        """The ids of a segment, from the table of last tokens of its prefixes."""
        last, sizes, pairs, many = [-1] * len(segment), self.sizes, self.pairs, len(self.pieces)
        if not self.known.issuperset(segment):
            for at, c in enumerate(segment):
                if c not in self.known:
                    last[at] = 0
        done = -1
        for end, (token, size) in self.automaton.iter(segment):
            if end == done:
                continue
            start = end - size
            if start >= 0:
                left = last[start]
                fits = pairs.get(left * many + token)
                if fits is None:
                    fits = self.compatible(left, token)
                if not fits:
                    continue
            last[end] = token
            done = end
        out, at = [], len(segment) - 1
        while at >= 0:
            token = last[at]
            if token:
                out.append(token)
            else:
                out.extend(self.byte_ids[b] for b in reversed(segment[at].encode()))
            at -= sizes[token]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text; null counts as empty, and an empty text has none."""
        return [i for s in self._split(text) for i in self.segment_ids(s)]

    def _split(self, text: str | None) -> list[str]:
        return self.segments(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []

    def _plain(self, ids: list[int]) -> str:
        try:
            return "".join([self.plain[i] for i in ids])
        except TypeError:  # there are bytes or control ids among them
            pass
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if i not in self.control:
                out.append(self.pieces[i])
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined to characters, marks turned into spaces, the dummy prefix taken off."""
        text = self._plain(ids)
        return text.removeprefix(SPACE_MARK).replace(SPACE_MARK, " ")

    def encode_text(self, text: str | None) -> tuple[str, str]:
        """Ids joined by commas, and the text decoded from them, through the worker's memory."""
        segments, memory = self._split(text), self.memory
        found = [memory[s] for s in segments]
        try:
            ids, plain = ",".join(found), "".join(segments)
        except TypeError:  # some decode to another text
            ids = ",".join([f if isinstance(f, str) else f[0] for f in found])
            plain = "".join([s if isinstance(f, str) else f[1] for s, f in zip(segments, found, strict=True)])
        return ids, plain.removeprefix(SPACE_MARK).replace(SPACE_MARK, " ")


def _utf8(raw: bytes) -> str:
    """Bytes to text; each byte that is no part of a character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + n]).decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Memory(dict):
    """Segment -> its ids joined by commas, or (ids, text) where the ids decode to another text, in two generations of bounded size.

    When the young one is full it becomes the old one, out of which segments that come again are taken back; what has
    not come again by then is forgotten.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.old: dict = {}
        self.room = REMEMBERED_BYTES

    def __missing__(self, segment: str) -> str | tuple[str, str]:
        value = self.old.pop(segment, None)
        if value is None:
            ids = self.model.segment_ids(segment)
            shown = self.model.shown
            value = ",".join([shown[i] for i in ids])
            plain = self.model._plain(ids)
            if plain != segment:
                value = value, plain
            if len(segment) > LONG_SEGMENT:
                return value
        self.room -= ENTRY_BYTES + 3 * len(segment)
        if self.room < 0:
            self.old = dict(self)
            self.clear()
            self.room = REMEMBERED_BYTES
        self[segment] = value
        return value

    def forget(self) -> None:
        """Free what is remembered: a worker that waits or does other work next should not hold it."""
        self.clear()
        self.old, self.room = {}, REMEMBERED_BYTES
        self.model.pairs.clear()


@lru_cache(maxsize=2)
def load(proto: bytes) -> Model:
    return Model(proto)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids (array, if keep_ids), ids_text (comma-joined), decoded.

    Null text counts as empty and has no ids; repeated rows and ids give repeated rows; other columns are dropped. Whole
    texts are encoded; a long one needs its list of segments in memory. An empty table gives an empty result.
    No shuffle: each task encodes the rows it reads. The model file is read by the driver and sent along, since
    executors need not have it.
    """
    text_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        proto = f.read()
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_text", T.StringType()), T.StructField("decoded", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        model = load(proto)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                both = [model.encode_text(t) for t in part.column(1).to_pylist()]
                ids = pa.array([x[0] for x in both], pa.string())
                counts = pa.array([x[0].count(",") + 1 if x[0] else 0 for x in both], pa.int64())
                columns = [part.column(0), counts, ids, pa.array([x[1] for x in both], pa.string())]
                if keep_ids:
                    columns.append(pa.array([[int(i) for i in x[0].split(",")] if x[0] else [] for x in both], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        model.memory.forget()

    return docs.select(id_col, text_col).mapInArrow(lean(run), T.StructType(fields))


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents() reduced to id, n_tokens, ids_sha256 and decoded_sha256 where the texts are, for checks."""
    text_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        proto = f.read()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        model = load(proto)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            rows = [(i.count(",") + 1 if i else 0, sha(i), sha(d)) for i, d in (model.encode_text(t.as_py()) for t in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], schema.names)
        model.memory.forget()

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)
