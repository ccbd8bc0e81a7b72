"""Token counts: whole-token shortcut."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, Tokenizer, pre_tokenizers

from granary.llm.common import id_and_text, table

#: Distinct pre-tokens with their counts that a Python worker keeps at most before it starts anew.
CACHE = 500_000
#: Longer pre-tokens are counted but not kept, so the cache's bytes are bounded too.
CACHE_CHARS = 64
LAST_LATIN = "\u017f"
BEYOND_LATIN = re.compile(f"[^\x00-{LAST_LATIN}]")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself, or the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def classes() -> dict[str, list[tuple[str, str]]]:
    """The library's own letters, numbers and white space, as ranges for a character class.

    The library and Python's modules follow different versions of Unicode, so the classes are
    read off the library: code points in a row, split by each class. The planes left out have
    neither characters of these classes nor places where any could be assigned so far.
    """
    every = "".join(chr(c) for c in [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)])
    out = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(every)
        out[name] = [(x[0], x[-1]) for x, _ in runs]
    return out


def with_classes(pattern: str, ranges: dict[str, list[tuple[str, str]]], last: str) -> re.Pattern:
    """The file's pattern with explicit classes, as far as code point ``last``."""
    for name, runs in ranges.items():
        pattern = pattern.replace(name, "".join(f"\\U{ord(a):08x}-\\U{ord(min(b, last)):08x}" for a, b in runs if a <= last))
    return re.compile(pattern)


class ShortcutCounter(dict):
    """Counts tokens of a byte-level, word-end BPE tokenizer file; as a dict, tokens by pre-token.

    ``proven`` holds the vocabulary strings that the model itself, run once over its own
    vocabulary, gives back as one token. Any other pre-token is merged by the model when it
    first comes, and kept in a bounded cache.
    """

    def __init__(self, path: str, ranges: dict[str, list[tuple[str, str]]]):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.latin, self.pattern = with_classes(pattern, ranges, LAST_LATIN), with_classes(pattern, ranges, "\U0010ffff")
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        end = spec["model"]["end_of_word_suffix"]
        self.proven: dict[str, int] = {}
        for piece in spec["model"]["vocab"]:
            word = piece.removesuffix(end)
            if word != piece and word and all(c in back for c in word):
                try:
                    text = bytes(back[c] for c in word).decode()
                except UnicodeDecodeError:
                    continue  # part of a character: never a whole pre-token
                if self.merged(text) == 1:
                    self.proven[text] = 1
        self.update(self.proven)

    def merged(self, word: str) -> int:
        """The model's own token count of one pre-token."""
        return len(self.library.model.tokenize("".join([self.letters[b] for b in word.encode()])))

    def __missing__(self, word: str) -> int:
        tokens = self.merged(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE + len(self.proven):
                self.clear()
                self.update(self.proven)
            self[word] = tokens
        return tokens

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of the text as the library normalises it, but for white space, which none holds.

        Up to U+017F every text is in NFC, and lower-cases character by character.
        """
        if BEYOND_LATIN.search(text):
            return self.pattern.findall(self.library.normalizer.normalize_str(text))
        return self.latin.findall(text.lower()) if "\u0130" not in text else self.pattern.findall(text.lower())

    def count(self, text: str) -> int:
        total = len(self.special.findall(text)) if "<|" in text else 0
        for part in self.special.split(text) if total else [text]:
            total += sum(map(self.__getitem__, self.pieces(part)))
        return total


_counters: dict[str, ShortcutCounter] = {}


def _counter(path: str, ranges: dict[str, list[tuple[str, str]]]) -> ShortcutCounter:
    """One for each Python worker and file."""
    if path not in _counters:
        _counters[path] = ShortcutCounter(path, ranges)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every whole text; one row for each row.

    ``path`` is a tokenizer file that every executor can read (installed with the Python
    environment). Counts equal the library's without added special tokens; special strings
    inside a text count as one token each, its default. A null or empty text has 0 bytes and
    tokens. Repeated rows and null ids stay; other columns are ignored. An empty table gives
    no rows. Texts are counted one at a time, so a long one needs memory for itself alone.
    """

    ranges = classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, ranges)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
