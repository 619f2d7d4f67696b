"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a text the last token of its encoding is unique. The table stores that token per prefix: an Aho-Corasick
automaton over the vocabulary lists the tokens that end at a position, and the one that is compatible with the last
token of the prefix in front of it is the prefix's last token. A pair (a, b) is compatible when merging the text of both by
the merge ranks gives a and b again; the tests are memoised. The ids are then read off the table backwards.

Texts are cut where no token can reach across (between a word and the spaces in front of the next one, and between letters
and other characters, if no piece of the vocabulary mixes them), each distinct part is encoded once while it stays in a
bounded cache, and characters outside the vocabulary become byte tokens and are barriers too.

Normalisation is the model's own for this kind of model: a space in front, spaces as U+2581, nothing else changed.
Null or empty text: no ids but the end id. Null doc_id: kept as null. Very long texts are encoded whole. Repeated rows get equal rows each.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chat import batched
from .common import bounded_batches, held

SPACE = "▁"
CACHE = 700_000
_WORDS = re.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PrefixTableBpe:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = model.eos_id()
        self.text: list[bytes] = []
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.text.append(b"")
            else:
                self.rank[p], self.id[p] = -model.get_score(i), i
                self.text.append(p.replace(SPACE, " ").encode())
        self.piece = {i: p for p, i in self.id.items()}
        self.is_byte = frozenset(self.byte.values())
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, str, bytes]] = {}
        automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.merge(p) == [p]:  # a token that merging never makes can't be last
                automaton.add_word(p, (i, len(p)))
        automaton.make_automaton()
        self.automaton = automaton
        self.chars = {p for p in self.id if len(p) == 1}
        odd = "".join(sorted(c for c in self.chars if c.isalnum() and not c.isalpha() and not c.isdecimal()))
        letter = re.compile(rf"[^\W\d_{odd}]")
        plain = (p.lstrip(SPACE) for p in self.id)
        mixes = any(len({bool(letter.match(c)) for c in p}) > 1 for p in plain)
        self.cut = _WORDS if mixes else re.compile(rf"{SPACE}*[^\W\d_{odd}]+|{SPACE}*(?:(?!{SPACE})[\W\d_{odd}])+|{SPACE}+")
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in self.id)

    def merge(self, text: str) -> list[str]:
        """Merge by rank, leftmost first: the definition, used for short strings only."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            x, y = self.piece[a], self.piece[b]
            known = self.pairs[a, b] = self.merge(x + y) == [x, y]
        return known

    def encode_run(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        if (i := self.id.get(text)) is not None and self.merge(text) == [text]:
            return [i]
        last: list[tuple[int, int] | None] = [None] * len(text)  # per prefix: last token and its length
        compatible = self.compatible
        for at, (token, n) in self.automaton.iter(text):
            before = at - n
            if last[at] is None and (before < 0 or ((p := last[before]) and compatible(p[0], token))):
                last[at] = (token, n)
        ids, at = [], len(text) - 1
        while at >= 0:
            token, n = last[at]
            ids.append(token)
            at -= n
        return ids[::-1]

    def encode_part(self, text: str) -> list[int]:
        if self.chars.issuperset(text):
            return self.encode_run(text)
        ids, run = [], []
        for c in text:
            if c in self.chars:
                run.append(c)
                continue
            if run:
                ids += self.encode_run("".join(run))
                run = []
            ids += [self.byte[b] for b in c.encode()]
        return ids + (self.encode_run("".join(run)) if run else [])

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        return self.cut.findall(whole) if self.cuttable else [whole]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(text) for i in self.encode_part(p)] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space in front that encoding adds is dropped."""
        text = b"".join(map(self.text.__getitem__, ids)).decode(errors="replace")
        first = next((i for i in ids if self.text[i]), None)
        return text[1:] if first is not None and text.startswith(" ") and first not in self.is_byte else text

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids with the end id, SHA-256 of the decimal ids, SHA-256 of the decoded text."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        n, decimals, decoded = 1, [], []
        for p in self.parts(text or ""):
            known = cache.get(p)
            if known is None:
                ids = self.encode_part(p)
                known = cache[p] = len(ids), " ".join(map(str, ids)), b"".join(map(self.text.__getitem__, ids))
            n += known[0]
            decimals.append(known[1])
            decoded.append(known[2])
        decimals.append(str(self.end))
        plain = b"".join(decoded)
        return n, hashlib.sha256(" ".join(decimals).encode()).hexdigest(), hashlib.sha256(plain[1:] if plain[:1] == b" " else plain).hexdigest()


def prefix_table_bpe(path: str) -> PrefixTableBpe:
    return held(("pieces", path), lambda: PrefixTableBpe(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: array<int> with the end id, of every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        model = prefix_table_bpe(path)
        for b in batches:
            yield from batched(((i, model.encode(t or "")) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), schema, 200)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text), from its encoding and decoding."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        model = prefix_table_bpe(path)
        for b in batches:
            yield from batched(((i, *model.digests(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
