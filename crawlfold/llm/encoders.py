"""Token ids of public tokenizer files, inside tasks.

``load(path)`` gives an encoder whose ids are those of the library for the
file: ``tokenizers`` for .json, ``sentencepiece`` for .model, without begin,
end or added special tokens. A .json file that is plain byte-level BPE (merges
in id order, no normaliser, the usual split pattern) is run by ``tiktoken``
over the very vocabulary of that file: the same ids at four times the speed
(``tests/llm/test_tokens.py`` compares both libraries; on load both must agree
on a probe, else ``tokenizers`` is used).
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

PROBE = ["", " ", "Hello  world\n\n I'm 12,345 été 你好 \U0001f600 <|endoftext|>x", "a" * 300, "\t\r\n  it's !!"]


def file_digest(path: str) -> str:
    """Digest of a tokenizer's version: its file's content and its library."""
    with open(path, "rb") as f:
        return hashlib.sha256(os.path.splitext(path)[1].encode() + b"\0" + f.read()).hexdigest()


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for 256, 257, ... in byte order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(spare)}


def _byte_level(path: str):
    """A tiktoken encoding of a byte-level BPE .json file, or None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
             and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("ignore_merges")
             and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if not plain or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
        return None
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    import public_tokenizers
    import tiktoken

    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@functools.lru_cache(maxsize=4)
def load(path: str):
    """A function from a list of texts to a list of id lists."""
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: piece.encode(texts, num_threads=1)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    exact = lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    fast = _byte_level(path)
    if fast is not None:
        quick = lambda texts: [fast.encode(t, allowed_special="all") for t in texts]
        if quick(PROBE) == exact(PROBE):
            return quick
    return exact
