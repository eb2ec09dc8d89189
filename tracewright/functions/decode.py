"""Token strings from ids, without losing or doubling a character; run inside Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

REPLACEMENT = "\ufffd"


def by_offsets(text: str, offsets: Sequence[tuple[int, int]]) -> list[str] | None:
    """The text cut at token offsets, no character twice; None unless the pieces join to the text.

    A token that begins inside what is already out gives only the rest, maybe nothing.
    """
    ends = [e for _, e in offsets]
    if ends and ends[-1] == len(text) and [s for s, _ in offsets] == [0, *ends[:-1]]:  # as most are: one after the other
        return [text[s:e] for s, e in offsets]
    out, at = [], 0
    for start, end in offsets:
        start = max(start, at)
        if start > at and text[at:start].strip():
            return None
        piece = text[at:end] if end > at else ""
        out.append(piece)
        at = max(at, end)
    if out and at < len(text):
        out[-1] += text[at:] if not text[at:].strip() else ""
    return out if "".join(out) == text else None


def by_bytes(pieces: Sequence[bytes]) -> list[str]:
    """Each character belongs to the token that holds its last byte; earlier fragments give an empty string.

    Bytes that are not UTF-8 become U+FFFD in the token where that is settled.
    """
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    out = [decoder.decode(p) for p in pieces]
    tail = decoder.decode(b"", True)
    if out:
        out[-1] += tail
    return out


def by_ids(ids: Sequence[int], decode: Callable[[list[int]], str], cache: dict[int, str] | None = None, strict: bool = False) -> list[str]:
    """Ids decoded one by one through a cache; refused if they don't join to the whole and ``strict``, or add U+FFFD."""
    cache = {} if cache is None else cache
    for i in ids:
        if i not in cache:
            cache[i] = decode([i])
    out = [cache[i] for i in ids]
    whole, joined = decode(list(ids)), "".join(out)
    if joined != whole and (strict or joined.count(REPLACEMENT) > whole.count(REPLACEMENT)):
        raise ValueError("tokens decoded one by one don't make up the text")
    return out
