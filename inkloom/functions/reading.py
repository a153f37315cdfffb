"""Recognised text made readable, and dialogue made plain: functions of one text, run in Arrow batches over distinct texts.

What is fixed is data: the tables of ``inkloom.rules`` and the values below.
The code says what is done with them. Tables run as cascades (``functions.cascade``),
so a text meets only the rules that can match it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from inkloom.functions.cascade import Cascade, Rules, cascade, folded, read_table
from inkloom.functions.text import QUOTES

# Passes of spacing and marks in the order in which they apply, sounds at the edge of dialogue, names, joins and continuations.
LEAD: Rules = ((r"_", " "), (r"^\s*~\s*", "..."))
MARKS: Rules = (
    (r"\s+([,.;:!?])", r"\1"), (r"([,.;:!?])(?=\S)", r"\1 "), (r"(?<=\d),\s+(?=\d{3}\b)", ","), (r"([!?.,;:])\s+([!?.,;:])", r"\1\2"),
    (r"([!?])\s+\1", r"\1\1"), (r"!\s+\?", "!?"), (r"\?\s+!", "?!"), (r"\.\s*\.\s*\.\s*", "..."), (r":\s*(?:\.\s*){2,}", "..."),
)
PIECES: Rules = ((r"(?i)\b(mobu|miwako)[.]{3}\s*san\b", r"\1-san"), (r"(?i)\bpar[.]{3}\s*ticu[.]{3}\s*lar\b", "particular"), (r"(?i)\blnder[.]{3}\s*stand\b", "UNDERSTAND"))
DOTS: Rules = ((r"(?<!\A)\.\.\.(?=[A-Za-z])", "... "), (r"(?<!\.)\.\.(?!\.)", "."))
TITLES: Rules = ((r"(?i)\b(Ms|Mrs|Mr|Dr):(?=\s+[A-Z])", r"\1."),)
WAVE: Rules = ((r":\s*['\"]?\s*~$", "..."),)
ENDS: Rules = (
    (r":\s*\.\.\.", "..."), (r"[:.]+\s*=$", "..."), (r"(?:,\s*){2,}$", "..."), (r"\s+-\s*$", "..."), (r"(?i)(?<=[A-Za-z])-\?$", "?"), (r"(?i)(?<=[A-Za-z])-$", "..."),
    (r":\s*,?\s*\.$", "..."), (r":\s*$", "."),
)
NAMES: Rules = ((r"(?i)\bmiwa\s*-\s*nee\b", "Miwa-nee"), (r"(?i)\bnaru\b", "Naru"), (r"(?i)\bame\s*-\s*no\s*-\s*gozen\b", "Ame-no-Gozen"))
PRONOUN: Rules = ((r"\bi\b", "I"), (r"\bi'm\b", "I'm"), (r"\bi’d\b", "I'd"), (r"\bi'd\b", "I'd"), (r"\bi’ll\b", "I'll"), (r"\bi'll\b", "I'll"), (r"\bi’ve\b", "I've"), (r"\bi've\b", "I've"))
FIRST: Rules = ((r"(?i)\bodfrom\b", "...from"), (r"(?i)\bWorldo\b", "World."), (r"(?i)\b4\s+(?=high\s+school)\b", "a "))
LAST: Rules = (
    (r"(?i)\bso\s*[:.]+\s*i\s*guess\b", "so I guess"), (r"(?i)\b1\s+(?=have|am|was|will|would|can|could|know|think|want|need)\b", "I "),
    (r"(?i)\bain['’]?t\s+I\s+told\s+you\b", "haven't I told you"), (r"(?i)\bain['’]?t\b", "is not"), (r"(?i)\bwhat\s+you\s+doing\b", "what are you doing"),
    (r"(?i)\bwhat\s+you\s+up\s+to\b", "what are you up to"), (r"(?i)\bno\s+climbing\s+nowhere\b", "not to climb anywhere"), (r"(?i)\byou,\s+not\s+to\b", "you not to"),
    (r"(?i)\bno\s+([a-z]+)ing\s+nowhere\b", r"not to \1 anywhere"), (r"(?i)\bno\s+more\b", "anymore"),
)
SOUNDS = """whisper sob shock jaka sfx bam bang boom thud clap rustle slam tap jolt gasp slap wobble yawn sposh flash tremble fidget twitch fwooo
    woosh crash nod scribble""".split()
JOINS = """apparently asphyxiation circumstances drugged interrupted kidnapped natsuko particular prepared serious student someone troubling
    understand useless yutaro""".split()
CUT_OFF = "what who where why huh".split()
CONTINUES = "but because before about with without from into catches lately importantly".split()
ING = {"doin": "doing", "goin": "going", "comin": "coming", "givin": "giving", "havin": "having", "makin": "making", "takin": "taking", "climbin": "climbing", "lookin": "looking", "riskin": "risking"}
# End of the fixed values.
EDGE = re.compile(r"(?i)^(?:{0})\b[.!?:, -]*|\s+\b(?:{0})[.!?:, -]*$".format("|".join(SOUNDS)))
EDGES, LONGEST = tuple(SOUNDS), max(map(len, SOUNDS))
WORD = re.compile(r"[A-Za-z][A-Za-z'’.-]*")
HYPHEN = re.compile(r"\b([A-Za-z]{2,})-\s+([A-Za-z]{2,})\b")
TORN = re.compile(r"\b([A-Za-z]{2,})[.]{3}\s*([A-Za-z]{2,})\b")
SHOUTED_I = re.compile(r"\b([A-Za-z]{3,})I([.!?]*)$")
AFTER_SHOUT = re.compile(r"!([.!?]+)$")
DROPPED_G = re.compile(r"\b([A-Za-z]+in)['’](?=\W|$)")
ODD_BLANKS = re.compile(r"[^\S ]\s*| \s+")
BEFORE_MARK, BLANK_MARKS = re.compile(r"\s+([,.;:!?])"), tuple(" " + c for c in ",.;:!?")
FIVE_WORDS = re.compile("(?<![A-Za-z])(?:[A-Za-z]++[^A-Za-z]++){4}[A-Za-z]")


def _have(m: re.Match) -> str:
    return m[0].lower().replace("'ve", " have").replace(" ve", " have")


@lru_cache(maxsize=32)
def table(name: str) -> Cascade:
    """A rule table of this package, once a worker."""
    return cascade(tuple((p, _have if to == "=have" else to) for p, to in read_table(name)))


def still(step: Callable[[str], str], text: str) -> str:
    """The step again and again until nothing changes."""
    while (new := step(text)) != text:
        text = new
    return text


def run(rules: Rules, text: str) -> str:
    return cascade(rules)(text)


def joined(pattern: re.Pattern, to: Callable[[re.Match], str], mark: str) -> Callable[[str], str]:
    """A substitution for texts that hold the mark, which every match has."""
    return lambda t: pattern.sub(to, t) if mark in t else t


def soft_hyphen(apart: frozenset[str] = frozenset()) -> Callable[[re.Match], str]:
    """Joins two halves of a word, unless the second is a word of its own that answers a broken-off one."""
    return lambda m: m[0] if m[2].lower() in apart else m[1] + m[2]


WHOLE, BROKEN_OFF, KNOWN = soft_hyphen(), soft_hyphen(frozenset(CUT_OFF)), frozenset(JOINS)


def known_join(m: re.Match) -> str:
    """Joins two pieces of a word around dots, if the list has the word."""
    return m[1] + m[2] if (m[1] + m[2]).lower() in KNOWN else m[0]


def pieces(text: str) -> str:
    """Words torn by dots joined, the listed shapes first."""
    return still(joined(TORN, known_join, "..."), table("font")(run(PIECES, text)))


def open_end(text: str) -> str:
    """Listed lines, and three words or more of which the last wants to go on, end in an ellipsis."""
    text = table("ellipses")(text.strip())
    if text.endswith(("...", "?!", "!?")) or not re.match("[A-Za-z]", text.removesuffix("\n")[-1:]):
        return text
    words = re.findall(r"[A-Za-z][A-Za-z'’]*", text)
    goes_on = re.search(r"(?i)\b(?:{})$".format("|".join(CONTINUES)), text)
    return text + "..." if goes_on and len(words) >= 3 else text


@lru_cache(maxsize=64)
def spaced(text: str) -> str:
    """Blanks and marks in order, halves of words joined, open ends marked."""
    text = " ".join(text.replace("’", "'").split())
    if not text:
        return ""
    text = still(joined(HYPHEN, WHOLE, "-"), run(LEAD, text))
    if ";" in text and len(WORD.findall(text)) <= 8:
        text = text.replace(";", ",")
    text = table("font")(pieces(run(MARKS, text)))
    text = run(ENDS, run(WAVE, run(TITLES, run(DOTS, text))))
    return " ".join(open_end(text).split())


def mixed_case(word: str) -> bool:
    letters = "".join(c for c in word if c.isalpha())
    return len(letters) >= 3 and any(map(str.islower, letters)) and any(map(str.isupper, letters)) and not (letters[0].isupper() and all(map(str.islower, letters[1:])))


def random_case(text: str) -> bool:
    """A word in mixed case among six, or one beside two words in capitals."""
    words = WORD.findall(text)
    odd = sum(map(mixed_case, words))
    return odd >= 1 and (odd >= 0.15 * len(words) or sum(len(w) >= 3 and w.upper() == w for w in words) >= 2)


@lru_cache(maxsize=64)
def cased(text: str) -> str:
    """Spaced, and in lower case where case is random; capitals throughout are left alone."""
    text = spaced(text)
    letters = "".join(filter(str.isalpha, text))
    if not WORD.search(text) or letters.upper() == letters or not random_case(text):
        return text
    low = spaced(run(NAMES, run(PRONOUN, text.lower())))
    return low[:1].upper() + low[1:] if letters[0].isupper() and low[:1].isalpha() else low


def shouts(text: str) -> str:
    """A mark read as a letter at the end, and the dots behind it."""
    if text.rstrip(".!?\n").endswith("I"):
        text = SHOUTED_I.sub(r"\1!\2", text)
    return AFTER_SHOUT.sub(lambda m: "!" + m[1].replace(".", ""), text)


def at_edge(text: str) -> bool:
    """Whether the text begins or ends with the letters of a sound: others have none at their edges."""
    return folded(text[:LONGEST]).startswith(EDGES) or folded(text.rstrip(".!?:, -\n")[-LONGEST:]).endswith(EDGES)


def quiet(text: str, then: Callable[[str], str] = str) -> str:
    """Sounds at the edges taken off."""
    return still(lambda t: then((EDGE.sub("", t) if at_edge(t) else t).strip()), text)


def readable(text: str, words: Cascade | None = None, contexts: Cascade | None = None) -> str:
    """A recognised text in order: spacing, case, sounds at the edges, misread words, letter shapes and phrases.

    Own cascades of ``words`` and ``contexts`` run behind those of the package.
    """
    text = cased(spaced(text))
    if len(WORD.findall(text)) >= 5:
        text = quiet(text, spaced)
    text = table("words")(text)
    text = table("font")(words(text) if words else text)
    text = table("contexts")(text)
    return cased(spaced(shouts(contexts(text) if contexts else text)))


def compact(text: str) -> str:
    """Blanks collapsed, quotes at the ends and blanks before marks removed."""
    text = text.strip().strip(QUOTES)
    if " ".join(text.split()) != text:
        text = ODD_BLANKS.sub(" ", text)
    return BEFORE_MARK.sub(r"\1", text) if any(map(text.__contains__, BLANK_MARKS)) else text


def mended(text: str) -> str:
    """Halves of words at line ends joined; words broken off before an answer stay apart."""
    halves, torn = joined(HYPHEN, BROKEN_OFF, "-"), joined(TORN, known_join, "...")
    return still(lambda t: torn(table("font")(run(PIECES, halves(t)))), table("breaks")(text))


def corrected(text: str, words: Cascade | None = None, contexts: Cascade | None = None) -> str:
    """Dialogue (its capitals softened) with misreadings corrected; own cascades run behind the package's."""
    text = run(LEAD, re.sub("_+", "_", re.sub("[’`´]", "'", text)))
    if FIVE_WORDS.search(text):
        text = quiet(text)
    if re.search("[A-Za-z]", text):
        text = text.replace(";", ",")
    text = table("pronouns")(table("corrections")(table("font")(run(FIRST, mended(text)))))
    text = words(text) if words else text
    text = contexts(text) if contexts else text
    return compact(open_end(shouts(run(ENDS, run(TITLES, text)))))


def plain(text: str, own: Cascade | None = None) -> str:
    """Corrected dialogue in plain wording: phrases first, then the dropped g, then words."""
    text = table("phrases")(compact(text))
    if "in'" in text or "in’" in text:
        text = DROPPED_G.sub(lambda m: ING.get(m[1].lower(), m[1].lower() + "g"), text)
    text = run(LAST, table("tokens")(text))
    return compact(own(text) if own else text)
