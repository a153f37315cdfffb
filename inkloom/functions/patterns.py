"""Word lists and patterns. They hold no look-around, so that Java and RE2 read them alike."""

from __future__ import annotations

from inkloom.functions.cascade import needs


def bounded(words: str) -> str:
    """One of the words or phrases, not inside a longer word, in any case."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:$|[^\p{{L}}\p{{N}}_])"


def stems(words: str) -> list[str]:
    """Strings in small letters of which every text holds one that has one of the words or phrases; none, if that isn't known."""
    return sorted(needs(f"(?:{words})"))


def either(words: str) -> str:
    return "|".join(words.split())


# The word lists of the quality rules.
ENGLISH = """the a an and or to of in on for with from you your i me my we they he she it is are was were be been have has had
    do does did not no yes what why where when how who this that here there now then man director house key trip tokyo orphanage
    food shelter steal tiger agency skills bomb button press boss company dorm battle fault cry""".split()
TYPOS = """enolgh folr fopm colld hlnger tslrlmi napehouse nestern individlals repect respecl rlpted lnneces hideolt yol iwas
    idont iguess wolld bizarpe wopld iaeely lessil evepy theip dsich aohto dollarman thess bmusthvb gallenl aslep inifront t0"""
RESIDUE = """orphanage food shelter steal tiger agency skills? earn master animal form staff backup sake bomb dampen explosion
    button press boss company dorm posthaste lad ideals mafia battle fault cry days? place else worldly knowledge individuals?
    bandit star mercenary guy dollarman fick smug slam contents beans?"""
SAFE_UNTRANSLATED = "ok okay aww ah oh uh um hm hmm hum hey yo gon bam boom".split()
SAFE_UPPERCASE = "OK NON SFX RASHOMON DAZAI TANIZAKI ATSUSHI NAOMI KUNIKIDA".split()
SAFE_COPIES = "naru miwa atsushi dazai kanade fujimura usami rashomon gozen kariu vayne provost ichinose public transit".split()
QUESTION_WORDS = "what why how where when who is are do did does can could would should will"
FRENCH_STOP = """bonjour quoi pourquoi comment avec sans dans pour mais donc alors vous nous elle elles ils cela cette comme plus
    moins bien fait faire être avoir suis sont était étais mon ton son des une les aux est pas que qui sur par ici""".split()
ENGLISH_COMMON = """the and that this with from have will would could should what when where why there here your you they them
    their been being because into about after before world friend friends girl time work death door food shelter steal orphanage
    tiger bomb bandit""".split()
NAME_STOP = """The This That Then With From Just Maybe Well But And Now You They Get Know Out How When What Who Someone Chapter
    Story""".split()
SFX_WORDS = [
    "4-UM", "AAAA", "AHHH", "AHHH-", "@ORGL OOO", "BLAM", "BUMP", "CHA", "CHATTER", "CLACK", "CLICK", "CREAK", "CRASH", "DEEEAD",
    "FUMP", "FWP", "FBY", "KACHA", "KA CHA", "KIDCK", "LIGHTING UP", "LUNGE", "PINCH", "POKE", "POKE POKE", "RUMBLE", "SILENCE",
    "SLAM", "THUD", "TWITCH", "WHISPER", "WOOSH",
]
SIGNAGE = "atm card fee phone transfer store convenience".split()
CREDIT = r"mangafox|i?mangareader(?:net)?|hosted\s+at|we\s+take\s+no\s+credit|credit\s+goes|appropriate\s+parties|creation\s+editing|scanlation|raws?|translator|reader|viewer|upload(?:ed|er)"
TECHNICAL = r"phase\s*\d|monument|hive|maximum\s+depth|monument\s+height|stab\s+radius|notable\s+hives?|main\s+hall|drift|hall|depth|radius|diameter|height|meters?|kilometers?|km|oom"
PROFILE = r"characters?|majority\s+faction|opposing\s+faction|west\s+oasis\s+government|cyborg\s+soldiers?|master\s+and\s+pupil|in\s+control\s+of|aspiring|government|faction|profile|relationship\s+chart"
# One of which every match of the three above holds, in small letters.
CREDIT_STEMS = "mangafox mangareader hosted credit appropriate creation scanlation raw translator reader viewer upload".split()
TECHNICAL_STEMS = "phase monument hive depth radius hall drift diameter height meter km oom".split()
PROFILE_STEMS = "character faction west cyborg master control aspiring government profile relationship".split()
DIALOGUE = "I you we he she they what why how when where can could would should will are is"
INCOMPLETE_END = """and but or if that this the a an to of for from with without before after because about into onto on in at as
    than then while when where who what why how gotta gonna wanna lemme should could would can cannot can't will still just is
    isn't isnt aren't arent don't dont doesn't doesnt are am was were be been being do does did has have had catches counting
    change sources place understanding mis doi"""
INCOMPLETE_START = "have left saved only where but and then with without after before right maybe because until unless when while"
SHORT_ZONE = "and this is what|only found|wait a sec|where will it end|now i gotta|but our solrces say that|but our sources say that|i'm counting on|i am counting on"
SFX_MIX = """whisper sob shock jaka sfx bam bang boom thud clap rustle slam tap tch jolt gasp slap wobble yawn fidget twitch fwooo
    woosh crash nod scribble krehble krembue shivr fwoop brip whooosh"""
FRENCH_SOURCE = """je tu il elle nous vous ils elles le la les un une des de du ce cette ca est suis sont etre avoir pas que qui
    quoi ou pourquoi comment avec sans dans sur plus moins tres faire faut voila mais donc alors comme pour"""
ENGLISH_SOURCE = """i you we they he she it what why how where when who the a an to of and or is are was were be been have has had
    do does did not can will would should could wanna gonna gotta"""
TOKEN = r"[A-Za-zÀ-ÖØ-öø-ÿ']+"
PROFILE_TOKEN = r"[A-Za-z][A-Za-z'’-]*"
CAPITALISED = r"[A-Z][a-z][A-Za-z'’-]{2,}"
SYMBOLS = r"[=_{}<>|\\]"
LINE_BREAK = r"(?:^|[^\p{L}\p{N}_])[A-Za-z]{2,}-\s+[A-Za-z]{2,}(?:$|[^\p{L}\p{N}_])"
DIGIT_MIX = r"[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+|[$]"
RANDOM_CASE = r"[a-z][A-Z]|[A-Z][a-z][A-Z]"
COLON_OK = r"(?i)(?:^|[^\p{L}\p{N}_])(?:chapter|vol|volume|no|number|page)\s*:"
WEAK_END = r"[:,]\s*$"
WEIRD_CASE = r"[A-Z][a-z][A-Z]|[a-z][A-Z]"
WEIRD_RUN = "ll|rlp|lnn|olgh|lmi|pe?house|nestern|wopld|wolld|colld|fopm|folr|t0"
TERMINAL = r"[.!?][\"')\]]*\s*$"
ZONE_WORD = r"[A-Za-z']+"
INNER_BREAK = r"[.!?][\"')\]]?\s+[A-Z\"']"
FUSED_PHRASE = r"(?i)(?:^|[^\p{L}\p{N}_])all\s+righty!\s+then\?\s+we(?:'re| are)\s+off\.?$"
MEASURE = r"(?i)^\s*\d[\d,.\soO]*(?:m|km|cm|mm|%)\s*$"
LONG_CRY = r"(?i)^[a-z]{2,}a{3,}(?:\s*\([^)]{2,}\))?$"
DIALOGUE_WORD = r"[A-Za-z][A-Za-z']+"
CLAUSE_WORDS = "before|after|because|that|if|when"
SHORT_PHASES = ["stab", "hall", "drift", "main hall", "phase 4", "phase 5"]
# End of the fixed values.

RESIDUE_FORMS = [w for form in RESIDUE.split() for w in ([form[:-2], form.replace("?", "")] if form.endswith("?") else [form])]
TYPO = bounded(either(TYPOS))
RESIDUE_WORD = bounded(either(RESIDUE))
QUESTION_START = rf"(?i)^\s*(?:{either(QUESTION_WORDS)})(?:$|[^\p{{L}}\p{{N}}_])"
ZONE_END = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{either(INCOMPLETE_END)})\s*$"
ZONE_START = rf"(?i)^\s*(?:\.\.\.)?\s*(?:{either(INCOMPLETE_START)})(?:$|[^\p{{L}}\p{{N}}_])"
ZONE_PHRASE = bounded(SHORT_ZONE)
ZONE_SFX = bounded(either(SFX_MIX))
CLAUSE = bounded(CLAUSE_WORDS)
# What a search for the longer forms above finds something by.
ANY_DIGIT_MIX = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[$]"
ANY_RANDOM_CASE = r"[a-z][A-Z]"
