"""SentencePiece encoding and decoding of merge-type vocabularies with an agenda of adjacent symbol pairs.

1. Blanks become the meta symbol and one is put in front, as the model's (identity) normaliser does.
2. A text is cut where no piece of the vocabulary can reach across: in front of a run of meta symbols, if no piece holds
   one behind another character, round characters that stand in no piece of two or more, and in front of marks that
   no piece holds behind a letter. Merges in one part never depend on another part.
3. Each distinct part goes through the agenda once per task: the pair whose merged piece scores highest, the leftmost
   among equals, is merged, its new neighbours enter, entries whose symbols have changed are passed over. Symbols
   without a piece fall back to bytes. What the agenda gives is held against the library, batch by batch.
4. A text's ids are those of its parts in turn, and so is its decoded text.

The work is a scan: nothing is shuffled, and a task's memory is bounded by ``HELD`` parts and one Arrow slice.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = "▁"
#: Distinct parts a task remembers, and the longest that is worth remembering. Change speed only.
HELD, LONGEST = 600_000, 64


class PieceModel:
    """A model file as the agenda needs it; made once per Python worker and file."""

    _made: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            data = f.read()
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(data)
        norm, trained, kind = spec.normalizer_spec, spec.trainer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not trained.treat_whitespace_as_suffix
        if trained.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not trained.byte_fallback or not plain or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in spec.pieces):
            raise ValueError("only merge-type models with byte fallback, identity normalisation and no user-defined or unused pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.end = self.library.eos_id()
        self.score = {p.piece: -p.score for p in spec.pieces if p.type == kind.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kind.BYTE}
        self.piece = {i: p for p, i in self.id.items()}
        self.memo = _Memo(self)
        self.value = {i: b for b, i in self.byte.items()}
        if any(META in p.lstrip(META) for p in self.score):
            self.parts = lambda text: [text] if text else []
        else:
            pairs = {ab for p in self.score for ab in zip(p, p[1:])}
            bound = {c for ab in pairs for c in ab} | {META}
            marks = {c for c in bound if not c.isalpha() and c != META}
            while left := {b for a, b in pairs if b in marks and a not in marks and a != META}:
                marks -= left
            alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in bound)
            q = "".join(map(re.escape, sorted(marks)))
            self.parts = re.compile(f"{META}*[{q}]*[^{META}{q}{alone}]+|{META}*[{q}]+|[{alone}]|{META}+").findall if q and alone else re.compile(f"{META}*[^{META}]+|{META}+").findall

    @classmethod
    def at(cls, path: str) -> PieceModel:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def agenda(self, part: str) -> list[int]:
        """Ids of one part: merge the best adjacent pair until no pair has a piece."""
        score, symbol, n = self.score, list(part), len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        entries = [(score[m], i, m) for i, m in enumerate(a + b for a, b in zip(symbol, symbol[1:])) if m in score]
        heapq.heapify(entries)
        while entries:
            _, i, merged = heapq.heappop(entries)
            j = after[i]
            if j >= n or symbol[i] + symbol[j] != merged or not symbol[i]:
                continue
            symbol[i], symbol[j] = merged, ""
            after[i] = k = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                if (m := merged + symbol[k]) in score:
                    heapq.heappush(entries, (score[m], i, m))
            if (h := before[i]) >= 0 and (m := symbol[h] + merged) in score:
                heapq.heappush(entries, (score[m], h, m))
        out: list[int] = []
        for s in symbol:
            if s:
                got = self.id.get(s)
                out += [got] if got is not None else [self.byte[b] for b in s.encode()]
        return out

    def spell(self, ids: list[int]) -> str:
        """What ids of one part decode to: pieces with blanks for meta symbols, bytes as UTF-8."""
        out, held = [], bytearray()
        for i in ids:
            if (b := self.value.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.piece[i])
        return "".join(out).replace(META, " ") + held.decode("utf-8", "replace")

    def check(self, made: dict[str, list[int]]) -> None:
        """Hold parts against the library: one call for all, with a character between them that is a part of its own."""
        if not made:
            return
        if not self.parts(f"a\nb{META}\nc") == ["a", "\n", "b", META, "\n", "c"]:
            self.check_one_by_one(made)
            return
        lead, gap = self.agenda(META), self.agenda("\n")
        want = lead + [i for ids in made.values() for i in (*gap, *ids)]
        if self.library.encode("\n" + "\n".join(made)) != want:
            self.check_one_by_one(made)

    def check_one_by_one(self, made: dict[str, list[int]]) -> None:
        for part, ids in made.items():
            if part == META:
                continue  # the library takes no text for a lone meta symbol
            text, want = (part[1:], ids) if part.startswith(META) else ("\n" + part, self.agenda(META) + self.agenda("\n") + ids)
            got = self.library.encode(text)
            if got != want:
                raise ValueError(f"the agenda gives {want} for {part!r}, the library {got}")


class _Memo(dict):
    """Part to its ids as text, made on demand; ``fresh`` holds ids that the library has not seen yet, ``odd`` parts that decode to something else."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model, self.fresh, self.odd = model, {}, {}

    def __missing__(self, part: str) -> str:
        ids = self.model.agenda(part)
        self.fresh[part] = ids
        if (back := self.model.spell(ids)) != part.replace(META, " "):
            self.odd[part] = back
        got = " ".join(map(str, ids))
        if len(part) <= LONGEST:
            self[part] = got
        return got

    def settle(self) -> None:
        """After some texts: check what is new, keep within ``HELD``."""
        self.model.check(self.fresh)
        self.fresh = {}
        if len(self) > HELD:
            self.clear()
            self.odd.clear()


def encoded(model: PieceModel, text: str) -> tuple[str, str]:
    """The ids of a whole text as decimals with blanks between, the end id last, and what they decode to."""
    memo, end = model.memo, str(model.end)
    if not text:
        return end, ""
    whole = META + text.replace(" ", META)
    parts = model.parts(whole)
    ids = " ".join(map(memo.__getitem__, parts))
    back = "".join([memo.odd.get(p) or p.replace(META, " ") for p in parts]) if memo.odd else whole.replace(META, " ")
    return f"{ids} {end}", back.removeprefix(" ")


def decoded(model: PieceModel, ids: list[int]) -> str:
    """What the library's decode gives: pieces in turn, without the blank that was put in front; the end id says nothing."""
    return model.spell([i for i in ids if i in model.piece or i in model.value]).removeprefix(" ")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, ids (array of int, the end id last) and text as these ids decode.

    Null texts count as empty: the end id alone, which decodes to nothing. Texts of any length are taken whole; a part without
    a cut (thousands of letters on end) takes n log n steps. Rows with null or repeated doc_id stay apart; an empty table
    gives an empty result. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.at(vocabulary)
        for ids, texts in _slices(batches):
            found = [list(map(int, encoded(model, t or "")[0].split())) for t in texts]
            model.memo.settle()
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.int32())), pa.array([decoded(model, f) for f in found], pa.string())], ["doc_id", "ids", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, text string")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield part.column(0), part.column(1).to_pylist()


def encode_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``encode`` gives.

    Edge cases as in ``encode``. No list of ids is made: each part's ids are decoded once, and remembered where they don't
    give the part itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.at(vocabulary)
        for ids, texts in _slices(batches):
            rows = []
            for text in texts:
                line, back = encoded(model, text or "")
                rows.append((line.count(" ") + 1, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            model.memo.settle()
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)
