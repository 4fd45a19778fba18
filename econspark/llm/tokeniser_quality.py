"""Quality rules from tokenizer fertility.

Every distinct word is encoded once per table with each public vocabulary; a document's measures are sums over its
words: characters per token, share of byte-fallback tokens, entropy of the token distribution in bits. Each language (or,
where the language has no band, the main script of the text) has a band for them; a document outside is rejected. Cheap
base rules on words, symbols and repeats come first. One pass over the documents, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import need, send_by_value
from ._words import SPACE, WordTable, chunked, code_points, worker_cache
from .packing import word_encoder

send_by_value(__name__)

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Accepted measures; characters per token and entropy hold for every vocabulary.

    ``floors`` are least entropies of its own for each vocabulary, in place of ``entropy[0]``. A short text cannot reach a floor that
    nears log2 of its tokens, so that it need not have more than ``of_most`` of that.
    """

    chars_per_token: tuple[float, float] = (1.4, 7.0)
    byte_share: float = 0.10
    entropy: tuple[float, float] = (5.4, 13.0)
    floors: tuple[float, ...] = ()
    of_most: float = 0.75

    def floor(self, vocabulary: int, tokens: int) -> float:
        least = self.floors[vocabulary] if vocabulary < len(self.floors) else self.entropy[0]
        return min(least, self.of_most * float(np.log2(max(tokens, 1))))


#: By language code, else by script. Where tokens are single letters or bytes, entropy stays near that of the alphabet at any length,
#: so those scripts have floors below what 50 words of clean prose have (piece, then word vocabulary). Space-poor scripts have few characters per token and many fallback bytes.
BANDS: dict[str, Band] = {
    "en": Band((1.6, 7.0), 0.05),
    "de": Band((1.5, 7.0), 0.05),
    "fr": Band((1.4, 7.0), 0.05),
    "es": Band((1.4, 7.0), 0.05),
    "latin": Band((1.3, 7.0), 0.15),
    "greek": Band((0.5, 6.0), 0.50, floors=(3.9, 3.5)),
    "cyrillic": Band((0.8, 6.0), 0.30, floors=(5.4, 4.6)),
    "han": Band((0.3, 3.0), 0.90, floors=(4.1, 5.1)),
    "other": Band((0.2, 8.0), 0.95, floors=(3.7, 2.9)),
}
#: First and last code point of each script's main blocks.
SCRIPTS = {"latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)), "greek": ((0x370, 0x3FF),), "cyrillic": ((0x400, 0x52F),), "han": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, byte_share double, entropy double, reasons string"


def main_script(text: str) -> str:
    """The script with most letters; ``other`` without letters of a listed one."""
    points = np.frombuffer(text.encode("utf-32-le", "ignore"), "<u4")
    counts = {name: sum(int(((points >= a) & (points <= b)).sum()) for a, b in blocks) for name, blocks in SCRIPTS.items()}
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] else "other"


def repeated_words(rows: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(rows) < 4:
        return 0
    if int(rows.max()) < 1 << 21:
        key = rows[:-2] << 42 | rows[1:-1] << 21 | rows[2:]
    else:
        _, pair = np.unique(rows[:-1] << 32 | rows[1:], return_inverse=True)
        key = pair[:-1] << 32 | rows[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit, word = np.isin(key, twice), np.zeros(len(rows), bool)
    for i in range(3):
        word[i : len(rows) - 2 + i] |= hit
    return int(word.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Bits per token."""
    if not len(ids):
        return 0.0
    ordered = np.sort(ids)
    share = np.diff(np.concatenate(([0], np.flatnonzero(np.diff(ordered)) + 1, [len(ids)]))) / len(ids)
    return float(-(share * np.log2(share)).sum()) + 0.0


def piece_encoder(path: str) -> Callable[[], Callable]:
    """Words as encoded with a blank before them."""

    def make() -> WordTable:
        from itertools import chain

        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            coded = model.encode([w.decode() for w in words], num_threads=1)
            count = np.fromiter(map(len, coded), np.int32, len(coded))
            return np.fromiter(chain.from_iterable(coded), np.int32, int(count.sum())), count

        return encode

    return make


def _measure(data: bytes, lang: str | None, table: WordTable, rows: np.ndarray, bands: Mapping[str, Band]) -> dict:
    per_token, bits, sizes, share = [], [], [], 0.0
    word_chars = code_points(data) - (len(data) - len(data.translate(None, SPACE)))
    for i in range(len(table.encoders)):
        ids = table.gather(rows, i)
        per_token.append(word_chars / len(ids) if len(ids) else 0.0)
        bits.append(entropy(ids))
        sizes.append(len(ids))
        if i == 0 and len(ids):
            share = float(((ids >= 3) & (ids < 259)).mean())  # <0x00> to <0xFF>
    n, repeats = len(rows), repeated_words(rows)
    failed = n < 50 or 100 * repeats > 50 * n
    band = bands.get(lang or "") or bands[main_script(data.decode())]
    reasons = [
        name
        for name, bad in (
            ("base", failed),
            ("chars_per_token", any(not band.chars_per_token[0] <= x <= band.chars_per_token[1] for x in per_token)),
            ("byte_share", share > band.byte_share),
            ("entropy", any(not band.floor(i, sizes[i]) <= x <= band.entropy[1] for i, x in enumerate(bits))),
        )
        if bad
    ]
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": len(data) - len(data.translate(None, SYMBOLS)), "n_dup_lines": duplicate_lines(data),
        "n_repeat_words": repeats, "base_failed": failed, "kept": not reasons, "chars_per_token": per_token[0], "byte_share": share, "entropy": bits[0], "reasons": ",".join(reasons),
    }


def _task(piece_model: str, word_vocabulary: str | None, bands: Mapping[str, Band], at_text: int, at_lang: int | None, into: str) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
        fields = [pa.field(*(lambda n, k: (n, kinds[k]))(*m.split())) for m in MEASURES.split(", ")]
        encoders = [piece_encoder(piece_model), *([word_encoder(word_vocabulary)] if word_vocabulary else [])]
        table = worker_cache(("quality", piece_model, word_vocabulary), lambda: WordTable(*[make() for make in encoders]))
        for batch in batches:
            texts = batch.column(at_text).cast(pa.binary())
            langs = batch.column(at_lang).to_pylist() if at_lang is not None else [None] * batch.num_rows
            done: list[dict] = []
            for chunk in chunked((lang, text.as_py()) for lang, text in zip(langs, texts, strict=True)):
                plain = [text or b"" for _, text in chunk]
                for (lang, _), data, rows in zip(chunk, plain, table.rows(plain), strict=True):
                    done.append(_measure(data, lang, table, rows, bands))
            column = pa.StructArray.from_arrays([pa.array([d[f.name] for d in done], f.type) for f in fields], fields=fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, into])

    return run


def add_quality(docs: DataFrame, piece_model: str, word_vocabulary: str | None = None, bands: Mapping[str, Band] | None = None, text: str = "text", lang: str | None = "lang", into: str = "quality") -> DataFrame:
    """``docs`` with a struct of measures and the verdict ``kept``.

    ``piece_model`` is a model with byte fallback; ``word_vocabulary`` a second vocabulary, or none. Words are split at ASCII
    white space. Null and empty texts have zero measures and fail. A null, unknown or absent language takes the band of the
    text's script. A column of ``docs`` that has the name ``into`` is replaced; repeated rows are judged alike.
    """
    need(docs, text)
    docs = docs.drop(into)
    names = docs.columns
    at_lang = names.index(lang) if lang in names else None
    schema = StructType(list(docs.schema.fields)).add(into, StructType.fromDDL(MEASURES))
    return docs.mapInArrow(_task(piece_model, word_vocabulary, dict(bands or BANDS), names.index(text), at_lang, into), schema)


def rejected(docs: DataFrame, **options) -> DataFrame:
    """Rows that the rules reject, with the reasons."""
    return add_quality(docs, **options).where(~F.col("quality.kept"))
