"""Quality rules by tokeniser fertility: what public vocabularies make of a text.

Measures of each whole text, white space included: characters per token under two public vocabularies, the share of tokens
that are bytes the vocabulary falls back to, and the entropy of the token distribution, in bits. A text is rejected if a
measure lies outside the band of its script. Entropy grows with a text's length, so it is held to a share of the bits of its
number of words, `FULL` at most. Texts of fewer than `FEW` tokens have no dependable entropy and pass that band.

Beside them stand simple base measures: words, characters in words, symbols, repeated lines, words in repeated windows.
Words and windows are compared by hashes of 64 bits, for a block of texts at once.

Defined results: a null or empty text, or one without a word, has no measures (null), base_failed is true and kept false; its
words are 0; very long texts are taken whole, each by itself; repeated rows are judged each alone; an empty table gives no
rows; new columns replace those of the same name, others pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqwell.llm.bpe import Vocabulary
from seqwell.llm.words import SPACED, Block, blocks, mixed, tidy, windows

#: Bands by script, all inclusive: (least, most) characters per token of the piece vocabulary and of the byte-pair
#: vocabulary, most byte-fallback share, least share of entropy. Scripts that a vocabulary knows badly have wider bands.
BANDS = {
    "latin": ((1.3, 8.0), (1.3, 8.0), 0.10, 0.79),
    "cyrillic": ((1.0, 8.0), (0.4, 8.0), 0.10, 0.60),
    "greek": ((0.6, 8.0), (0.4, 8.0), 0.20, 0.50),
    "cjk": ((0.3, 4.0), (0.2, 4.0), 0.80, 0.40),
    "other": ((0.2, 8.0), (0.2, 8.0), 0.90, 0.30),
}
FULL = 200
FEW = 64
#: Code points where a script begins; up to the next one.
SCRIPT_STARTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2E80, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0xFF00, "cjk"), (0xFFF0, "other"), (0x20000, "cjk"), (0x32000, "other")]
#: Characters from which on a text is encoded by `bpe`, to the same tokens: the library's pattern runs out of stack on very long white space.
LONG = 200_000
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_NAMES = [b for _, b in SCRIPT_STARTS]


def script(text: str, raw: bytes) -> str:
    """The script of most letters beyond ASCII or, if they are few, of the ASCII ones."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if (data >= 0x80).sum() * 3 < len(data):
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    counts = np.bincount(np.searchsorted(_STARTS, points[points >= 0x41], side="right") - 1, minlength=len(_NAMES))
    by: dict[str, int] = {}
    for name, c in zip(_NAMES, counts.tolist(), strict=True):
        by[name] = by.get(name, 0) + c
    return max(by, key=lambda k: (by[k], k))


class Vocabularies:
    """A piece vocabulary and a byte-pair vocabulary."""

    def __init__(self, pieces: str, ranks: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.ranks, self.long = ranks, None
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.pairs = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def _long(self) -> Vocabulary:
        if self.long is None:
            self.long = Vocabulary(self.ranks)
        return self.long

    def measures(self, text: str) -> tuple[int, float, float, float, float]:
        """Pieces, characters a piece, characters a byte-pair token, share of pieces that are bytes, entropy of the pieces."""
        ids = np.array(self.pieces.encode(text, num_threads=1), dtype=np.int64)
        total = max(1, len(ids))
        share = np.unique(ids, return_counts=True)[1] / total
        pairs = max(1, len(self.pairs.encode_ordinary(text) if len(text) < LONG else self._long().encode([text])[0]))
        return len(ids), len(text) / total, len(text) / pairs, int(self.is_byte[ids].sum()) / total, float(-(share * np.log2(share)).sum())


def repeated_words(block: Block) -> np.ndarray:
    """Of each text the words in windows of three that are found twice or more in it."""
    count = np.diff(block.at)
    window, begin = windows(block.hashes(), block.at, 3)
    text = np.repeat(np.arange(block.n), np.diff(begin))
    key = mixed(window + mixed(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] = True
    # the first word of each window
    at = np.flatnonzero(again)
    word = block.at[text[at]] + at - begin[text[at]]
    twice = np.zeros(len(block.starts) + 3, dtype=bool)
    for k in range(3):
        twice[word + k] = True
    sums = np.concatenate([[0], np.cumsum(twice[: len(block.starts)])])
    return np.where(count < 4, 0, sums[block.at[1:]] - sums[block.at[:-1]])


def base_measures(block: Block) -> np.ndarray:
    """The columns of BASE of each text of a block."""
    of = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[block.offsets])
    repeated_lines = np.zeros(block.n, dtype=np.int64)
    for i in range(block.n):
        own = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes()
        if own.count(b"\n"):
            lines = [x for x in own.split(b"\n") if x.strip()]
            repeated_lines[i] = len(lines) - len(set(lines))
    return np.stack([np.diff(block.at), of(SPACED[block.data] & ((block.data & 0xC0) != 0x80)), of(SYMBOLS[block.data]), repeated_lines, repeated_words(block)], axis=1)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["chars_per_piece", "chars_per_pair", "byte_share", "entropy"]


def fits(band: tuple, words: int, total: int, found: list[float]) -> bool:
    """Whether the measures of a text of so many words and pieces lie in the band of its script."""
    piece, pair, most, entropy = band
    inside = piece[0] <= found[0] <= piece[1] and pair[0] <= found[1] <= pair[1] and found[2] <= most
    return inside and (total < FEW or found[3] >= entropy * np.log2(min(FULL, max(2, words))))


def measure(docs: DataFrame, *, text: str = "text", pieces: str | None = None, ranks: str | None = None, bands: dict = BANDS) -> DataFrame:
    """`docs` with the base measures, the fertility measures, script, base_failed and kept. pieces, ranks: the vocabularies' files."""
    import public_tokenizers

    pieces = pieces or public_tokenizers.path("piece_bpe_32k.model")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    new = [*BASE, *MEASURES, "script", "base_failed", "kept"]
    base = docs.select(*[f"`{c}`" for c in docs.columns if c not in new])
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabularies(pieces, ranks)
        for batch in batches:
            base_rows = np.zeros((len(batch), len(BASE)), dtype=np.int64)
            measures: list[list] = [[None] * len(batch) for _ in MEASURES]
            scripts: list[str | None] = [None] * len(batch)
            failed, kept = np.ones(len(batch), dtype=bool), np.zeros(len(batch), dtype=bool)
            for block in blocks(batch.column(at), SPACED, lower=False):
                own_rows = base_measures(block)
                base_rows[block.first : block.first + block.n] = own_rows
                for i in np.flatnonzero(own_rows[:, 0]).tolist():
                    raw = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes()
                    text, row = raw.decode(), block.first + i
                    n, repeated = int(own_rows[i, 0]), int(own_rows[i, 4])
                    total, *found = known.measures(text)
                    for column, x in zip(measures, found, strict=True):
                        column[row] = x
                    scripts[row] = script(text, raw)
                    failed[row] = n < 50 or 100 * repeated > 50 * n
                    kept[row] = not failed[row] and fits(bands[scripts[row]], n, total, found)
            columns = [*(pa.array(base_rows[:, k]) for k in range(len(BASE))), *(pa.array(x, pa.float64()) for x in measures), pa.array(scripts, pa.string()), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    kinds = ["long"] * len(BASE) + ["double"] * len(MEASURES) + ["string", "boolean", "boolean"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + [f"{c} {k}" for c, k in zip(new, kinds, strict=True)])
    return base.mapInArrow(tidy(run), schema)
