"""Word lists of the feature specification.

Fixed values: the entries below define what the features count, so they must
match the specification exactly.  A different specification can be loaded with
``duelframe.sources.resources.load_lexicons``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values -----------------------------------------------------------
SECOND_PERSON = "you your yours yourself yourselves you're you'll you've you'd"
FIRST_SINGULAR = "i me my mine myself i'm i've i'll i'd"
FIRST_PLURAL = "we us our ours ourselves we're we've we'll we'd let's"
THIRD_PERSON = (
    "he she him her hers his himself herself they them their theirs themselves "
    "he's she's they're they've"
)
DEMONSTRATIVES = "this that these those"
WH_WORDS = "what why how when where who whom whose which"
INTENSIFIERS = (
    "very really actually literally totally absolutely completely utterly incredibly "
    "insanely seriously truly simply just so extremely unbelievably ridiculously "
    "genuinely downright entirely perfectly wildly"
)
SUPERLATIVES = (
    "best worst greatest biggest smallest most least finest largest hardest easiest "
    "fastest slowest strongest weakest funniest saddest craziest weirdest coolest "
    "cutest ugliest richest poorest happiest top ultimate definitive supreme perfect"
)
POSITIVE_WORDS = (
    "good great love loved loves best happy happiness amazing awesome beautiful "
    "wonderful perfect win wins winning won hope hopeful inspiring inspired brilliant "
    "excellent joy joyful kind kindness proud success successful strong brave smart "
    "clever sweet warm fun funny hilarious incredible remarkable heartwarming uplifting "
    "triumph celebrate gift free easy helpful healthy safe save saved saves better "
    "improve improved thank thanks grateful favorite favourite delight delightful cheer"
)
NEGATIVE_WORDS = (
    "bad worst hate hated hates sad sadness terrible awful horrible ugly fail fails "
    "failed failure lose loses lost losing angry anger fear afraid scared scary dangerous "
    "danger death dead die dies dying kill killed killing sick disease pain painful hurt "
    "hurts cruel abuse attack war crisis disaster tragedy tragic broken break wrong "
    "mistake problem problems worse worry worried shocking shocked disturbing outrage "
    "outrageous disgusting shame ashamed guilty poverty poor"
)
POLARITY_SCORE = 0.6
NEGATORS = (
    "not no never none nothing nobody without cannot can't don't doesn't didn't won't "
    "wouldn't shouldn't isn't aren't wasn't weren't hasn't haven't hadn't couldn't ain't "
    "nor neither"
)
NEGATION_WINDOW = 3
FIRST_TOKEN_CLASSES = {
    "wh": "how what when where which who whom whose why",
    "determiner": (
        "a all an another any both each either every neither no some such that the these "
        "this those what which"
    ),
    "pronoun": (
        "anybody anyone everybody everyone he her hers him his i it its me mine my nobody "
        "nothing our ours she somebody someone something their theirs them they us we you "
        "your yours"
    ),
    "auxiliary": (
        "am are aren't be been being can can't could couldn't did didn't do does doesn't "
        "don't had has have is isn't may might must shall should shouldn't was wasn't were "
        "weren't will won't would"
    ),
    "preposition": (
        "about across after against among at before behind between beyond by during for "
        "from in into near of on over since through to toward towards under upon with "
        "within without"
    ),
    "verb_common": (
        "ask behold check come discover find forget get give go guess help here imagine "
        "introducing know learn let listen look make meet need prepare read remember say "
        "see start stop take tell there think try want watch"
    ),
}
# ---- end of fixed values ----------------------------------------------------


def _words(text: str) -> list[str]:
    return text.split()


@dataclass(frozen=True)
class Lexicons:
    """Word lists by category; ``polarity`` maps a score to the words that carry it."""

    second: list[str] = field(default_factory=lambda: _words(SECOND_PERSON))
    first_sing: list[str] = field(default_factory=lambda: _words(FIRST_SINGULAR))
    first_plur: list[str] = field(default_factory=lambda: _words(FIRST_PLURAL))
    third: list[str] = field(default_factory=lambda: _words(THIRD_PERSON))
    demonstratives: list[str] = field(default_factory=lambda: _words(DEMONSTRATIVES))
    wh_words: list[str] = field(default_factory=lambda: _words(WH_WORDS))
    intensifiers: list[str] = field(default_factory=lambda: _words(INTENSIFIERS))
    superlatives: list[str] = field(default_factory=lambda: _words(SUPERLATIVES))
    polarity: dict[float, list[str]] = field(
        default_factory=lambda: {
            POLARITY_SCORE: _words(POSITIVE_WORDS),
            -POLARITY_SCORE: _words(NEGATIVE_WORDS),
        }
    )
    negators: list[str] = field(default_factory=lambda: _words(NEGATORS))
    negation_window: int = NEGATION_WINDOW
    first_token: dict[str, list[str]] = field(
        default_factory=lambda: {k: _words(v) for k, v in FIRST_TOKEN_CLASSES.items()}
    )


DEFAULT_LEXICONS = Lexicons()
