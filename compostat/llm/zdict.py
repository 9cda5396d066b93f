"""zstandard dictionaries as models of text: how many bytes a window takes once the
dictionary's text is known."""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: ASCII: letters in lower case, everything else a space; bytes of other letters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: What zstandard takes for a trained dictionary starts with these bytes (fixed value).
_MAGIC = bytes.fromhex("37A430EC")


def words_of(text: str, chars: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lower-case words of letters, in lists of bounded size."""
    at = 0
    while at < len(text):
        to = min(len(text), at + chars)
        while to < len(text) and not text[to].isspace():
            to += 1
        yield text[at:to].lower().encode("utf-8", "replace").translate(_LETTERS).split()
        at = to


def trained(samples: list[bytes], size: int, level: int, segment: int = 32, pattern: int = 8) -> bytes:
    """A dictionary that zstandard trains on ``samples``: the segments of ``segment``
    bytes whose ``pattern``-byte sequences recur most, and entropy tables.  Where there is
    too little to train on, the samples themselves (their last ``size`` bytes)."""
    import zstandard

    upto = size
    while upto >= 256:
        try:
            return zstandard.train_dictionary(upto, samples, level=level, k=segment, d=pattern).as_bytes()
        except zstandard.ZstdError:
            upto //= 2
    return b" ".join(samples)[-size:]


def sizer(content: bytes, level: int, min_match: int = 0, lead: bytes = b"") -> Callable[[bytes], int]:
    """The compressed size of a window, given ``content`` as dictionary (trained, or raw
    text).  ``min_match`` is the shortest match taken (0: the level's own).  With ``lead``, a
    piece of the dictionary that goes before every window and is taken off again, the fixed
    cost of a compressed block is paid and short windows shrink too."""
    import zstandard

    kind = zstandard.DICT_TYPE_FULLDICT if content.startswith(_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    # zstandard ignores dictionaries of under 8 bytes.
    known = zstandard.ZstdCompressionDict(content.ljust(64), dict_type=kind)
    own = {"min_match": min_match} if min_match else {}
    how = zstandard.ZstdCompressionParameters.from_level(level, source_size=512, dict_size=max(64, len(content)), write_content_size=False, write_checksum=False, write_dict_id=False, **own)
    known.precompute_compress(compression_params=how)
    compress = zstandard.ZstdCompressor(compression_params=how, dict_data=known).compress
    if not lead:
        return lambda window: len(compress(window))
    base = len(compress(lead))
    return lambda window: len(compress(lead + window)) - base
