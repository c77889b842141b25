"""Regular expressions for emoji clusters, built from a range table."""

from __future__ import annotations

# ---- fixed values: code point ranges that count as emoji ---------------------
EMOJI_RANGES = [
    (126976, 127023), (127136, 127231), (127232, 127487), (127488, 127743),
    (127744, 128511), (128512, 128591), (128640, 128767), (128768, 128895),
    (128896, 129023), (129024, 129279), (129280, 129535), (129536, 129647),
    (129648, 129791), (9728, 9983), (9984, 10175), (11008, 11263),
    (8252, 8252), (8265, 8265), (8505, 8505), (8596, 8618), (8986, 8987),
    (9000, 9000), (9167, 9167), (9193, 9210), (9410, 9410), (9642, 9643),
    (9654, 9654), (9664, 9664), (9723, 9726), (10548, 10549), (12336, 12336),
    (12349, 12349), (12951, 12951), (12953, 12953),
]
MODIFIERS = [65038, 65039, 8205, 8419, 127995, 127996, 127997, 127998, 127999]
REGIONAL_INDICATORS = (127462, 127487)
ZERO_WIDTH = [0x200B, 0x200C, 0x200D, 0xFEFF]
JOINER = 0x200D
# ---- end of fixed values ----------------------------------------------------


def char_class(ranges: list[tuple[int, int]]) -> str:
    """Body of a regex character class, valid in Java and RE2."""
    return "".join(
        f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges
    )


_points = lambda values: [(v, v) for v in values]

REGIONAL_CLASS = char_class([REGIONAL_INDICATORS])
EMOJI_CLASS = char_class(EMOJI_RANGES) + REGIONAL_CLASS
MODIFIER_CLASS = char_class(_points([m for m in MODIFIERS if m != JOINER]))
ZERO_WIDTH_CLASS = char_class(_points(ZERO_WIDTH))
DECORATION_CLASS = EMOJI_CLASS + char_class(_points(MODIFIERS)) + ZERO_WIDTH_CLASS

# Two regional indicators make one flag; otherwise a base takes its modifiers and
# any number of joined continuations.
CLUSTER = (
    f"(?:[{REGIONAL_CLASS}]{{2}}"
    f"|[{EMOJI_CLASS}][{MODIFIER_CLASS}]*"
    f"(?:\\x{{{JOINER:X}}}[{EMOJI_CLASS}][{MODIFIER_CLASS}]*)*)"
)
