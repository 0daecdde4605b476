"""Exact, cached encoding by a ``tokenizers`` file of the word_bpe_49k kind (lower case, word ends, white space dropped)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Characters for which normalisation is plain lower-casing; text with others goes through the library as a whole.
PLAIN = re.compile("[!-~¡-¬®-ÿ]+")
#: The file's own pre-token pattern.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Marks of special tokens, and accents: with some of them only the small letter has a composed form.
AS_IS = "<\\||[\u0300-\u036f]"
SUFFIX, END = "</w>", b"\n"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """The bytes that the byte-level characters stand for."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A file's merges as ranks of byte strings, a word's end being END, and the id of each rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.fits = model["type"] == "BPE" and model.get("end_of_word_suffix") == SUFFIX
        self.fits = self.fits and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not self.fits:
            return
        chars = byte_of_char()

        def spelt(token: str) -> bytes:
            ends = token.endswith(SUFFIX)
            return bytes(chars[c] for c in (token[: -len(SUFFIX)] if ends else token)) + (END if ends else b"")

        vocab, back = model["vocab"], {b: c for c, b in chars.items()}
        self.ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + END: 256 + b for b in range(256)}
        ids = [vocab.get(back[b], 0) for b in range(256)] + [vocab.get(back[b] + SUFFIX, 0) for b in range(256)]
        self.pairs = []
        for m in model["merges"]:
            x, y = m.split(" ") if isinstance(m, str) else m
            self.fits = self.fits and not x.endswith(SUFFIX) and spelt(x + y) not in self.ranks
            self.pairs.append((spelt(x), spelt(y)))
            self.ranks[spelt(x + y)] = len(ids)
            ids.append(vocab[x + y])
        self.id_of = np.array(ids)

    def exact(self) -> bool:
        """Whether merging by the rank of what two neighbours make is merging by the rank of the pair.

        It is if every token's bytes, merged by lower ranks alone, end as the token's own pair.
        """
        if not self.fits:
            return False
        for k, (x, y) in enumerate(self.pairs):
            body = (x + y).removesuffix(END)
            parts = [body[i : i + 1] for i in range(len(body))]
            parts[-1] += (x + y)[len(body) :]
            while len(parts) > 1:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
                if best >= 512 + k:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if parts != [x, y]:
                return False
        return True


@lru_cache(maxsize=8)
def by_rank(path: str) -> bool:
    """Whether a file's words may be merged by rank; the driver asks and tells the workers."""
    return Merges(path).exact()


_MADE: dict[tuple, "WordEncoder"] = {}


def word_encoder(path: str, merged: bool) -> "WordEncoder":
    """One encoder for each worker process and file; ``merged`` is what ``by_rank`` says of it."""
    if (path, merged) not in _MADE:
        _MADE[path, merged] = WordEncoder(path, merged)
    return _MADE[path, merged]


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (``n[0]`` numbers), at[1], ..."""
    end = np.cumsum(n)
    return np.repeat(at - end + n, n) + np.arange(end[-1] if len(end) else 0)


class WordEncoder:
    """ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    White space always ends a pre-token, so a text's ids are those of its white-space chunks in order. The chunks of a
    batch are looked up together in a bounded cache, which keeps the commoner half when it is full. Of the misses, plain
    ones are cut into words and merged by rank all together; others, with characters that the normaliser may change or
    the marks of special tokens, go through the library's whole pipeline.
    """

    def __init__(self, path: str, merged: bool = False, most_chunks: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.core = None
        if merged:
            import tiktoken

            merges = Merges(path)
            self.id_of, self.ends = merges.id_of, np.zeros(len(merges.id_of), bool)
            self.ends[[r for b, r in merges.ranks.items() if len(b) > 1 and b.endswith(END)]] = True
            self.core = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=merges.ranks, special_tokens={})
        self.most_chunks = most_chunks
        self.known, self.pool = pa.array([], pa.string()), np.empty(0, np.uint16)
        self.at = self.n = self.hits = np.empty(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Add chunks to the cache, in their order."""
        plain, joined = np.zeros(len(chunks), bool), "\n".join(chunks)
        if self.core is not None:
            plain[:] = True if PLAIN.fullmatch("".join(chunks)) and "<|" not in joined else [bool(PLAIN.fullmatch(c)) and "<|" not in c for c in chunks]
        n, parts = np.zeros(len(chunks), np.int64), []
        odd = [chunks[k] for k in np.nonzero(~plain)[0]]
        if odd:
            got = [self.whole.encode(c, add_special_tokens=False).ids for c in odd]
            n[~plain] = [len(ids) for ids in got]
            parts.append(np.array([i for ids in got for i in ids], np.uint16))
        if plain.any():
            words, per = [], []
            for c in (joined if plain.all() else "\n".join(chunks[k] for k in np.nonzero(plain)[0])).lower().split("\n"):
                if c.isalpha():
                    words.append(c)
                    per.append(1)
                else:
                    found = WORDS.findall(c)
                    words += found
                    per.append(len(found))
            got = self.core.encode_to_numpy("\n".join(words) + "\n", disallowed_special=())
            ends = np.concatenate([[0], np.nonzero(self.ends[got])[0] + 1])[np.concatenate([[0], np.cumsum(per)])]
            n[plain] = np.diff(ends)
            parts.append(self.id_of[got[: ends[-1]]].astype(np.uint16))
        order = np.concatenate([np.nonzero(~plain)[0], np.nonzero(plain)[0]])
        at = np.empty(len(chunks), np.int64)
        at[order] = len(self.pool) + np.cumsum(n[order]) - n[order]
        self.pool = np.concatenate([self.pool, *parts])
        self.at, self.n, self.hits = np.concatenate([self.at, at]), np.concatenate([self.n, n]), np.concatenate([self.hits, np.zeros_like(n)])
        self.known = pa.concat_arrays([self.known, pa.array(chunks, pa.string())])

    def _shrink(self) -> None:
        keep = np.argsort(-self.hits, kind="stable")[: self.most_chunks // 2]
        n = self.n[keep]
        self.pool = self.pool[spread(self.at[keep], n)]
        self.known, self.at, self.n, self.hits = self.known.take(pa.array(keep)), np.cumsum(n) - n, n, self.hits[keep] // 2

    def encode_column(self, texts: pa.Array, at_once: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts one after another, number of each text's), in order, about ``at_once`` bytes of text at a time."""
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + at_once, side="right")))
            yield self._found(pa.concat_arrays([texts.slice(a, z - a), texts.slice(0, 0)]))  # without an offset
            a = z

    def _found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Lower case of ASCII letters makes fewer chunks and changes no ids, but beside AS_IS.
        texts = pc.if_else(pc.match_substring_regex(texts, AS_IS), texts, pc.ascii_lower(texts))
        for space in "\t\n\v\f\r":
            texts = pc.replace_substring(texts, space, " ")
        lists = pc.split_pattern(texts, " ")
        chunks = lists.flatten()
        found = pc.index_in(chunks, value_set=self.known)
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            new = chunks.filter(pc.is_null(found)).dictionary_encode()
            place[place < 0] = len(self.known) + new.indices.to_numpy(zero_copy_only=False)
            self._learn(new.dictionary.to_pylist())
        self.hits += np.bincount(place, minlength=len(self.hits))
        n = self.n[place]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[spread(self.at[place], n)]
        if len(self.known) > self.most_chunks:
            self._shrink()
        cuts = lists.offsets.to_numpy()
        return ids, np.diff(end[cuts - cuts[0]])

    def encode(self, text: str | None) -> bytes:
        """ids of one text as little-endian 16-bit bytes."""
        return next(self.encode_column(pa.array([text], pa.string())))[0].astype("<u2").tobytes()
