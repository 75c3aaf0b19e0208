"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary alone."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_runs

#: Distinct pre-tokens whose ids a task remembers.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """A printable character for each byte: Latin-1's visible ones stand for themselves, the others follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file of lines ``base64 rank``, by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return [ranks[i] for i in range(len(ranks))]


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes after them."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-rank, type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    return model.SerializeToString()


class ByteBpe:
    """Encoder and decoder of one vocabulary; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode new pre-tokens in one call; one that is a token itself is that token."""
        rest = []
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            if (rank := self.whole.get(raw)) is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            else:
                rest.append((piece, raw.decode("latin-1").translate(self.letters)))
        for (piece, _), ids in zip(rest, self.model.encode([mapped for _, mapped in rest], num_threads=1)):
            self.known[piece] = b"".join([i.to_bytes(4, "little") for i in ids])

    def encode(self, text: str) -> bytes:
        pieces = self.split(text)
        if len(self.known) > REMEMBERED:
            self.known = {}
        if new := set(pieces).difference(self.known):
            self.learn(new)
        known = self.known
        return b"".join([known[p] for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, lossless[, ids]) of every row, from its whole text.

    Null text counts as empty: no ids, digests of nothing. ``lossless`` says whether the decoded bytes are the text's.
    ``keep_ids`` adds the ids as array<int>. Other columns are left out, whatever their names; repeated rows
    and null ids stay; very long texts are encoded whole, a pre-token at a time; an empty table gives no rows.
    """
    tokens = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, serialise(tokens), pattern))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*shared.value)
        sha = hashlib.sha256
        for batch, texts in text_runs(batches):
            count, ids_sha, text_sha, same, kept = [], [], [], [], []
            for one in texts:
                ids = bpe.encode(one) if one else b""
                back = bpe.decode(ids)
                count.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(back).hexdigest())
                same.append(back == (one or "").encode("utf-8", "replace"))
                if keep_ids:
                    kept.append(memoryview(ids).cast("I").tolist())
            columns = {id_col: batch.column(0), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string()), "lossless": pa.array(same, pa.bool_())}
            if keep_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean" + ", ids array<int>" * keep_ids)
