"""Rule-based polarity of a text after the published VADER rules (Hutto and Gilbert, 2014).

Texts come case-folded, so the emphasis of capitals plays no part.
"""

from __future__ import annotations

import math
import string
from collections import ChainMap
from collections.abc import Mapping

# Words that negate what follows.
NEGATORS = frozenset((
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt",
    "neednt", "neither", "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "without", "wont", "wouldnt", "rarely", "seldom", "despite", "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't", "don't",
    "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't", "needn't", "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't",
    "won't", "wouldn't",
))
# Words that strengthen or weaken what follows, and by how much.
STRONGER, WEAKER = 0.293, -0.293
_STRONGER_WORDS = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "effing", "enormously", "entirely", "especially",
    "exceptionally", "extremely", "fabulously", "flipping", "flippin", "fricking", "frickin", "frigging", "friggin", "fully", "fucking", "greatly",
    "hella", "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely", "quite", "really", "remarkably",
    "so", "substantially", "thoroughly", "totally", "tremendously", "uber", "unbelievably", "unusually", "utterly", "very",
)
_WEAKER_WORDS = (
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly",
    "somewhat", "sorta", "sortof", "sort-of", "just enough", "kind of", "sort of",
)
BOOSTERS = dict.fromkeys(_STRONGER_WORDS, STRONGER) | dict.fromkeys(_WEAKER_WORDS, WEAKER)
# Phrases with a valence of their own.
IDIOMS = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0, "kiss of death": -1.5, "hand to mouth": -2.0}
# Marks of which one is taken off a word, at one end.
MARKS = (".", "!", "?", ",", ";", ":", "-", "'", '"', "!!", "!!!", "??", "???", "?!?", "!?!", "?!?!", "!?!?")
# Negation, damping by distance, contrast, punctuation, and the norm's constant.
NEGATION, DAMPING, BEFORE_BUT, AFTER_BUT = -0.74, (1.0, 0.95, 0.9), 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, MANY_QUESTIONS, NORM = 0.292, 4, 0.18, 0.96, 15

_NO_PUNCTUATION = str.maketrans("", "", string.punctuation)


class Polarity:
    """Scores texts with a dictionary of valences and sets of negators and boosters."""

    def __init__(self, valences: Mapping[str, float], negators=NEGATORS, boosters: Mapping[str, float] = BOOSTERS) -> None:
        self.valences, self.negators, self.boosters = valences if isinstance(valences, ChainMap) else dict(valences), frozenset(negators), dict(boosters)

    def tokens(self, text: str) -> list[str]:
        """White-space tokens of two characters or more.

        One known mark before or after a token goes, if what is left stands in the text without any
        punctuation; so ``good!`` is a known word and ``(good)`` or ``good!!!!`` is not.
        """
        words = text.split()
        once = set(words)
        # Punctuation is no white space, so it can be taken out of each distinct word.
        odd = [w for w in once if not w[0].isalnum() or not w[-1].isalnum()]
        if not odd:
            return [w for w in words if len(w) > 1]
        plain = {w for w in (w if w.isalnum() else w.translate(_NO_PUNCTUATION) for w in once) if len(w) > 1}
        bare = {w: self._unmarked(w, plain) for w in odd}
        return [bare.get(w, w) for w in words if len(w) > 1]

    @staticmethod
    def _unmarked(raw: str, plain: set[str]) -> str:
        for mark in MARKS:
            if raw.startswith(mark) and raw[len(mark) :] in plain:
                return raw[len(mark) :]
            if raw.endswith(mark) and raw[: -len(mark)] in plain:
                return raw[: -len(mark)]
        return raw

    def negates(self, word: str) -> bool:
        return word in self.negators or "n't" in word

    def _valence(self, words: list[str], i: int) -> float:
        word = words[i]
        if word in self.boosters or (word == "kind" and words[i + 1 : i + 2] == ["of"]) or word not in self.valences:
            return 0.0
        value = self.valences[word]
        for back in (1, 2, 3):
            if i < back or words[i - back] in self.valences:
                continue
            push = self.boosters.get(words[i - back], 0.0) * DAMPING[back - 1]
            value += push if value >= 0 else -push
            value *= self._negation(words, i, back)
            if back == 3:
                value = self._idiom(words, i, value)
        if i and words[i - 1] == "least" and "least" not in self.valences and words[i - 2 : i - 1] not in (["at"], ["very"]):
            value *= NEGATION
        return value

    def _negation(self, words: list[str], i: int, back: int) -> float:
        """Negators turn a value round; ``never so`` and ``never this`` strengthen it, and ``so`` or ``this`` alone at the widest look."""
        word, stress = words[i - back], ("so", "this")
        if back == 2 and word == "never" and words[i - 1] in stress:
            return 1.5
        if back == 3 and ((word == "never" and words[i - 2] in stress) or words[i - 1] in stress):
            return 1.25
        return NEGATION if self.negates(word) else 1.0

    def _idiom(self, words: list[str], i: int, value: float) -> float:
        """The valence of an idiom that ends at, precedes or begins with a word; and boosters of two words before it."""
        say = lambda a, b: " ".join(words[a : b + 1])
        for a, b in ((i - 1, i), (i - 2, i), (i - 2, i - 1), (i - 3, i - 1), (i - 3, i - 2)):
            if say(a, b) in IDIOMS:
                value = IDIOMS[say(a, b)]
                break
        for b in (i + 1, i + 2):
            if b < len(words):
                value = IDIOMS.get(say(i, b), value)
        return value + (WEAKER if say(i - 3, i - 2) in self.boosters or say(i - 2, i - 1) in self.boosters else 0.0)

    def scores(self, text: str) -> tuple[float, float, float, float]:
        """Shares of negative, neutral and positive, and the compound of -1 to 1."""
        words = self.tokens(text)
        if not words:
            return 0.0, 0.0, 0.0, 0.0
        # A word that is repeated counts as it does where it stands first; only words with a value of their own are looked at.
        first = dict(zip(reversed(words), range(len(words) - 1, -1, -1)))
        known = {w: v for w, i in first.items() if w in self.valences and (v := self._valence(words, i))}
        places = [i for i, w in enumerate(words) if w in known] if known else []
        values = [known[words[i]] for i in places]
        if values and "but" in first:
            turn = first["but"]
            values = [v * (BEFORE_BUT if i < turn else AFTER_BUT if i > turn else 1) for i, v in zip(places, values)]
        questions = text.count("?")
        push = min(text.count("!"), MOST_EXCLAMATIONS) * EXCLAMATION
        push += 0 if questions < 2 else questions * QUESTION if questions < 4 else MANY_QUESTIONS
        total = sum(values, 0.0)
        total += math.copysign(push, total) if total else 0
        compound = total / math.sqrt(total * total + NORM)
        pos, neg, neutral = sum(v + 1 for v in values if v > 0), sum(v - 1 for v in values if v < 0), len(words) - len(values) + values.count(0)
        if pos > -neg:
            pos += push
        elif pos < -neg:
            neg -= push
        every = pos - neg + neutral
        return round(abs(neg / every), 3), round(neutral / every, 3), round(pos / every, 3), round(compound, 4)
