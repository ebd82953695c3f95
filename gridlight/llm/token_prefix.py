"""Exact token counts by prefix dynamic programming.

For one pre-token the table is filled left to right: the encoding of a byte prefix
ends in the one token t whose predecessor, the last token of the shorter prefix, may
stand before t (merging the two byte strings together gives back exactly the two
tokens).  Its count is the shorter prefix's count plus one.  A text's table is the
running sum over pre-tokens plus the table inside the current one, so the count of
any prefix, the longest prefix within a budget and the total need no second encoding.

Totals per pre-token are remembered per Python worker up to a number of entries and of
characters; of a text, the table of the pre-token last cut into is kept.

Defined results: null text is empty (0 bytes, 0 tokens); special strings inside a
text count as the one added token, as the library has it by default; repeated rows
and null ids are returned as they are; an empty table gives no rows; further columns
are ignored.  Texts are encoded whole; one unbroken run of characters costs time and
memory in proportion to its length.  Ties between prefixes of equal count go to the
longest.  A tokenizer file that needs more than byte-level merging is refused.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

LIMIT = 512
# fixed values: the byte-level pre-token pattern of this vocabulary family
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _check(model: dict) -> None:
    """Refuse files whose text handling these tables do not reproduce."""
    splitter = model.get("pre_tokenizer") or {}
    flags = ("lstrip", "rstrip", "single_word", "normalized")
    wrong = [
        "normalizer" if model.get("normalizer") else "",
        "pre_tokenizer" if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) else "",
        "model" if model["model"].get("type", "BPE") != "BPE" else "",
        *(k for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix") if model["model"].get(k)),
        *(f"added token with {k}" for t in model.get("added_tokens", ()) for k in flags if t.get(k)),
    ]
    if any(wrong):
        raise ValueError(f"this tokenizer needs what is not supported: {', '.join(sorted(set(filter(None, wrong))))}")


class PrefixTokenizer:
    def __init__(self, path: str, remember: int = 400_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        _check(model)
        letters = _byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(t) for t in model["model"]["vocab"]}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.vocab))
        self.special = {t["content"] for t in model["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.white = regex.compile(r"\s")
        self.alone: dict[bytes, bool] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.remember = 2 * remember
        self.prefixes: dict[bytes, tuple[int, bytes]] = {}
        self.held: tuple[bytes, list[int]] = (b"", [0])
        self.totals = _Totals(self, remember)

    def merged(self, word: bytes) -> list[bytes]:
        """Merge by rank; only used on one or two tokens' bytes."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank, never = self.rank, len(self.rank)
        while len(parts) > 1:
            ranks = [rank.get(p, never) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == never:
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(ranks) and ranks[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _may_follow(self, left: bytes, token: bytes) -> bool:
        known = self.pairs.get((left, token))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[left, token] = self.merged(left + token) == [left, token]
        return known

    def _is_token(self, piece: bytes) -> bool:
        known = self.alone.get(piece)
        if known is None:
            known = self.alone[piece] = self.merged(piece) == [piece]
        return known

    def _step(self, word: bytes, end: int, known) -> tuple[int, bytes]:
        """(count, last token) of word[:end]; ``known(i)`` gives that of word[:i]."""
        for start in range(max(0, end - self.longest), end):
            token = word[start:end]
            if token in self.vocab and self._is_token(token):
                if not start:
                    return 1, token
                count, last = known(start)
                if self._may_follow(last, token):
                    return count + 1, token
        raise ValueError("the vocabulary lacks a byte")

    def table(self, word: bytes) -> list[int]:
        """Token counts of word[:0], word[:1], ..., word; the last long one is kept."""
        if self.held[0] == word:
            return self.held[1]
        rows = [(0, b"")]
        for end in range(1, len(word) + 1):
            rows.append(self._step(word, end, rows.__getitem__))
        counts = [count for count, _ in rows]
        if len(word) > 48:
            self.held = (word, counts)
        return counts

    def total(self, word: bytes) -> int:
        """Last entry of the table.  Words share their prefixes' entries."""
        n, known = len(word), self.prefixes
        if n > 48:
            return self.table(word)[-1]
        have = n
        while have and word[:have] not in known:
            have -= 1
        if have < n and len(known) > self.remember:
            known.clear()
            have = 0
        for end in range(have + 1, n + 1):
            known[word[:end]] = self._step(word, end, lambda i: known[word[:i]])
        return known[word][0] if n else 0

    def pieces(self, text: str) -> list[str]:
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out

    def count(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.pieces(text)))


class _Totals(dict):
    def __init__(self, owner: PrefixTokenizer, limit: int, max_chars: int = 16_000_000):
        super().__init__({s: 1 for s in owner.special})
        self.owner, self.limit, self.max_chars, self.chars = owner, limit, max_chars, 0

    def __missing__(self, piece: str) -> int:
        total = self.owner.total(piece.encode("utf-8"))
        if len(piece) > self.max_chars:
            return total
        if len(self) >= self.limit or self.chars + len(piece) > self.max_chars:
            self.clear()
            self.update({s: 1 for s in self.owner.special})
            self.chars = 0
        self[piece] = total
        self.chars += len(piece)
        return total


class PrefixCounts:
    """Exact token counts of every prefix (in characters) of one text."""

    def __init__(self, tokenizer: PrefixTokenizer, text: str):
        self.tokenizer, self.text = tokenizer, text
        self.pieces = tokenizer.pieces(text)
        self.tokens = [0, *accumulate(map(tokenizer.totals.__getitem__, self.pieces))]

    @property
    def total(self) -> int:
        return self.tokens[-1]

    def _starts(self) -> list[int]:
        if not hasattr(self, "_at"):
            self._at = [0, *accumulate(map(len, self.pieces))]
        return self._at

    def _white(self, k: int) -> bool:
        """Whether pre-token k is white space; it is all or not at its end."""
        piece = self.pieces[k]
        return piece not in self.tokenizer.special and self.tokenizer.white.match(piece[-1]) is not None

    def _inside(self, start: int, end: int) -> list[int]:
        """Tokens of text[start:start], text[start:start + 1], ..., text[start:end], which
        are one pre-token each; the last such table is kept."""
        if getattr(self, "_held", (None,))[0] != (start, end):
            piece = self.text[start:end]
            table = self.tokenizer.table(piece.encode("utf-8"))
            if not piece.isascii():
                table = [table[i] for i in accumulate((len(c.encode("utf-8")) for c in piece), initial=0)]
            self._held = ((start, end), table)
        return self._held[1]

    def at(self, chars: int) -> int:
        """Tokens of text[:chars]: the sum before the pre-token that the cut falls into, and
        that one's table.  White space that ends at the cut closes up to one pre-token; the
        parts of a special string or a contraction are split anew."""
        if chars <= 0:
            return 0
        starts, pieces, special = self._starts(), self.pieces, self.tokenizer.special
        k = bisect_right(starts, chars - 1) - 1
        piece, white = pieces[k], self._white(k)
        if starts[k + 1] == chars and not white:
            return self.tokens[k + 1]
        if piece in special:
            k = max(k - 1, 0)  # part of a special string is ordinary text
            while k and self._white(k) and self._white(k - 1):
                k -= 1
            return self.tokens[k] + self.tokenizer.count(self.text[starts[k] : chars])
        if white or chars - starts[k] == 1 and piece[0] == " ":
            last = k
            while k and self._white(k - 1):
                k -= 1
            while last < len(pieces) and self._white(last):
                last += 1
            end = starts[last]
            if last < len(pieces) and pieces[last] not in special and pieces[last][0] == " ":
                end += 1
            return self.tokens[k] + self._inside(starts[k], end)[chars - starts[k]]
        if piece[0] == "'" and piece[1].isalpha():
            return self.tokens[k] + self.tokenizer.count(self.text[starts[k] : chars])
        return self.tokens[k] + self._inside(starts[k], starts[k + 1])[chars - starts[k]]

    def fit(self, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        starts = self._starts()
        k = bisect_right(self.tokens, budget) - 1
        # a cut further on can only save tokens inside the pre-token after it, or where
        # white space that the cut ends closes up
        ahead = min(k + 1, len(self.pieces))
        while ahead < len(self.pieces) and self._white(ahead - 1):
            ahead += 1
        for chars in range(starts[ahead], starts[k], -1):
            if self.at(chars) <= budget:
                return chars
        return starts[k]


_loaded: dict[str, PrefixTokenizer] = {}


def tokenizer(path: str) -> PrefixTokenizer:
    if path not in _loaded:
        _loaded[path] = PrefixTokenizer(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (longest prefix within the limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            n_bytes, n_tokens, fit = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                counts = PrefixCounts(own, text)
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(counts.total)
                fit.append(counts.fit(limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    )


def op8_token_prefix(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, sf_dir, "documents"), path)
