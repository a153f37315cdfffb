"""Replace personal data by keyed surrogates of the same kind, gender, script and format.

Native: only DataFrame functions. The steps:

1. One regular expression finds mentions: e-mail addresses, IP addresses, card
   and phone numbers, social security numbers, secrets (keys, tokens, long
   hexadecimal strings) and names (after a title, or a known given name before a
   capitalised word). Text without the signs of a mention is passed on untouched.
2. A mention gives parts (kind, class, canonical form): e-mail addresses in
   lower case, phones and cards as digits, names word by word. Equal parts
   corefer, wherever they are and however they are formatted; a given name has
   the gender that most of its mentions in the corpus show.
3. Every distinct part draws a candidate from SHA-256 of the secret key, its
   kind, canonical form and attempt. Candidates that another part holds, or
   that occur as an original of that kind, are drawn again until none is left;
   so distinct originals keep distinct surrogates, none of them an original.
   Every few attempts a candidate grows by a character (an address leaves its
   network), so a format with few values doesn't run out.
4. A surrogate is written in the mention's own format: case, separators.

Only documents with such signs are shuffled. Distinct texts carry their parts, so
copies cost one row; a very common part is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.llm.common import settle

L = r"\p{L}\p{M}"
# Titles and common given names, with the gender that they show.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Don", "Sir", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Lady", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Doctor", "Professor"],
}
GIVEN = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Peter", "Hans", "Jürgen", "Wolfgang", "Pierre", "Jean", "Jacques", "François", "Carlos", "José", "Juan", "Miguel", "Иван", "Дмитрий", "Сергей", "Γιώργος"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Anna", "Ursula", "Sabine", "Monika", "Marie", "Camille", "Élise", "Carmen", "María", "Isabel", "Lucía", "Ольга", "Мария", "Елена", "Ελένη"],
}


def _any(words: dict[str, list[str]]) -> str:
    return "|".join(w for group in words.values() for w in group)


CAPITAL = rf"\p{{Lu}}[{L}'’\-]{{1,40}}"
SECRET_WORD = r"(?:token|api[_-]?key|secret[_-]?key|access[_-]?key|secret|password|passwd)"
# Every mention begins where no letter or digit comes before; that one test comes first. Only a secret's key word may end a longer one (accessToken).
EMAIL = rf"[{L}\p{{N}}._%+\-]{{1,64}}+@[A-Za-z0-9\-]{{1,63}}(?:\.[A-Za-z0-9\-]{{1,63}}){{0,6}}\.[A-Za-z]{{2,24}}"
SECRET_HEAD = rf"(?i:{SECRET_WORD})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
# a value has a letter or digit: blanks to fill in aren't secrets
SECRET = rf"(?=[TASPtasp]){SECRET_HEAD}(?=[_\-+/]*+[A-Za-z0-9])[A-Za-z0-9_\-+/]{{8,}}+"
HEX = r"(?=[0-9A-Fa-f]{32})(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
IP6 = r"(?<!:)(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP4 = rf"(?=[0-9])(?<!\.)(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
CARD = r"(?=[0-9])(?<![.+\-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
SSN = r"(?=[0-9])(?<!\-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = r"(?=[0-9+(])(?<!\+)(?:\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{1,4}\)?){2,7}|(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3,4}[ .\-][0-9]{4})(?![0-9])"
NAME = rf"(?=\p{{Lu}})(?:(?:{_any(TITLES)})\.?[ \t]{CAPITAL}(?:[ \t]{CAPITAL}){{0,2}}|(?:{_any(GIVEN)})[ \t]{CAPITAL})"
ANY = rf"(?<![{L}\p{{N}}])(?:" + "|".join((EMAIL, SECRET, HEX, IP6, IP4, CARD, SSN, PHONE, NAME)) + rf")|{SECRET}"
#: What a text with any mention shows, in tests that cost little on text without one. Each kind has its sign: seven digits close together (cards,
#: social security numbers, phones without a plus) or four short groups with dots (IPv4), a plus before a digit, a hexadecimal run, IPv6 groups, a name.
SIGNS = (r"[0-9](?:(?:[ .()\-]{0,2}[0-9]){6}|\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9])", r"\+[0-9]", r"[0-9A-Fa-f]{32}", r"(?:[0-9A-Fa-f]{1,4}:){7}", NAME)


def may_mention(text: Column) -> Column:
    secret = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(rf"(?=[TASPtasp])(?i:{SECRET_WORD})")
    signs = F.contains(text, F.lit("@")) | secret
    for s in SIGNS:
        signs = signs | text.rlike(s)
    return F.coalesce(signs, F.lit(False))


PART = "struct<kind:string,cls:string,canon:string,raw:string,before:string>"


def _full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's rule over a string of digits whose last one is the check digit."""
    back = F.split(F.reverse(digits), "")
    terms = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, t: a + F.coalesce(t, F.lit(0)))


def _part(kind, cls, canon, raw, before=None) -> Column:
    fields = zip((kind, cls, canon, raw, F.lit("") if before is None else before), ("kind", "cls", "canon", "raw", "before"))
    return F.struct(*((F.lit(c) if isinstance(c, str) else c).cast("string").alias(n) for c, n in fields))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "c").when(word.rlike(r"\p{IsGreek}"), "g").otherwise("l")


def _gender(word: Column, lists: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for g in ("m", "f"):
        out = F.when(word.isin(lists[g]), g).otherwise(out)
    return out


def _name_parts(m: Column) -> Column:
    """Title and blanks are kept; words before the last are given names, the last is a surname."""
    words = F.split(m, "[ \t]")
    title = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    titled = title.isin([w for g in TITLES.values() for w in g])
    last = F.size(words) - 1

    def one(w: Column, i: Column) -> Column:
        gender = F.coalesce(_gender(w, GIVEN), F.when(titled, _gender(title, TITLES)), F.lit("n"))
        kind = F.when((i == 0) & titled, "").when(i == last, "surname").otherwise("given")
        cls = F.when(kind == "given", F.concat(gender, _script(w))).otherwise(_script(w))
        return _part(kind, cls, F.lower(w), w, F.when(i > 0, " ").otherwise(""))

    return F.transform(words, one)


def _secret_parts(m: Column) -> Column:
    """What names the secret is kept."""
    head = F.regexp_extract(m, "^" + SECRET_HEAD, 0)
    value = F.substr(m, F.length(head) + 1)
    hexed = value.rlike("^[0-9a-fA-F]+$") & ~(value.rlike("[a-f]") & value.rlike("[A-F]"))
    part = _part("secret", F.when(hexed, "hex").otherwise("any"), F.when(hexed, F.lower(value)).otherwise(value), value)
    return F.when(head == "", F.array(part)).otherwise(F.array(_part("", "", "", head), part))


def _mention_parts(m: Column) -> Column:
    d = _digits(m)
    lower = F.lower(m)
    inside = F.regexp_extract(m, r"^(10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|169\.254)\.", 1)
    return (
        F.when(F.contains(m, F.lit("@")), F.array(_part("email", "", lower, m)))
        .when(m.rlike(_full(IP4)), F.array(_part("ip", inside, m, m)))
        .when(m.rlike(_full(SSN)), F.array(_part("ssn", "", d, m)))
        .when(m.rlike(_full(CARD)), F.array(_part("card", F.when(_luhn(d) % 10 == 0, "luhn").otherwise("plain"), d, m)))
        .when(m.rlike(_full(PHONE)), F.array(_part("phone", F.when(m.startswith("+"), "+").otherwise(""), F.concat(F.when(m.startswith("+"), "+").otherwise(""), d), m)))
        .when(m.rlike(_full(NAME)), _name_parts(m))
        .when(m.rlike(_full(IP6)), F.array(_part("ip6", "hex", lower, m)))
        .otherwise(_secret_parts(m))
    )


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _parts(found: Column, text: Column) -> Column:
    """All parts in order; ``before`` is the text between a part and the one before."""
    gaps = F.split(text, ANY)

    def of_mention(m: Column, i: Column) -> Column:
        return F.transform(_mention_parts(m), lambda p, j: _part(p["kind"], p["cls"], p["canon"], p["raw"], F.when(j == 0, F.get(gaps, i)).otherwise(p["before"])))

    return F.flatten(F.transform(found, of_mention))


def candidate(key: str, kind: Column, cls: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate that a part draws at an attempt, in canonical form.

    Later attempts draw from more values: names and numbers get longer, inside
    addresses go to 10.0.0.0/8, and addresses to local IPv6 ones at last.
    """
    blocks = F.sequence(F.lit(0), F.floor(F.length(canon) / 30).cast("int") + 1)
    stream = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"), b.cast("string")), 256)), "")
    byte = lambda hashed, i: F.conv(F.substr(hashed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    at = lambda i: byte(stream, i)

    def pick(alphabet: str, i: Column, at=at) -> Column:
        return F.substr(F.lit(alphabet), at(i) % len(alphabet) + 1, F.lit(1))

    def letter(c: Column, i: Column, hexed: bool, at=at) -> Column:
        small, big = ("abcdef", "ABCDEF") if hexed else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return (
            F.when(c.rlike("[0-9]"), pick("0123456789", i, at)).when(c.rlike("[a-z]"), pick(small, i, at)).when(c.rlike("[A-Z]"), pick(big, i, at))
            .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя", i, at)).when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω", i, at))
            .when(c.rlike(r"\p{L}"), pick("áàâäéèêëíîïóôöúûüñç", i, at)).otherwise(c)
        )

    spare = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"), F.lit("more")), 256)
    more = F.substr(spare, F.lit(1), F.floor(attempt / 4).cast("int"))  # hexadecimal
    digits = F.translate(more, "abcdef", "012345")
    local6 = F.concat(F.lit("fd"), F.substr(spare, F.lit(1), F.lit(2)), *(F.concat(F.lit(":"), F.substr(spare, F.lit(i), F.lit(4))) for i in range(3, 31, 4)))
    shape = lambda s, hexed=False, skip=0: F.array_join(F.transform(F.split(s, ""), lambda c, i: letter(c, i + skip, hexed)), "")

    def spelled(hexed: bool) -> Column:
        """``shape(canon)`` with one hash for 32 characters at a time, so that long values take time in proportion to their length."""
        seed = F.when(F.length(canon) > 200, F.sha2(canon, 256)).otherwise(canon)

        def piece(c: Column, hashed: Column) -> Column:
            letters = lambda h: F.array_join(F.transform(F.split(c, ""), lambda x, i: letter(x, i, hexed, lambda j: byte(h, j))), "")
            return F.transform(F.array(hashed), letters)[0]

        def pieces(s: Column) -> Column:
            cut = F.regexp_extract_all(canon, F.lit("(?s).{1,32}"), F.lit(0))
            return F.array_join(F.transform(cut, lambda c, b: piece(c, F.sha2(F.concat_ws("\x1f", F.lit(key), kind, s, attempt.cast("string"), b.cast("string")), 256))), "")

        return F.transform(F.array(seed), pieces)[0]

    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    top = F.when(top.isin("com", "org", "net"), top).otherwise("com")
    host = F.regexp_replace(F.substring_index(domain, ".", 1), "^-|-$", "x")
    email = F.concat(shape(local), more, F.lit("@"), F.array_join(F.transform(F.split(host, ""), lambda c, i: letter(c, i + F.length(local), False)), ""), F.lit(".example."), top)
    # the country code's first digit stays; a subscriber number begins with 2 to 9
    lead = F.when(cls == "+", F.substr(canon, F.lit(1), F.lit(2))).otherwise("")
    rest = F.when(cls == "+", F.substr(canon, F.lit(3))).otherwise(canon)
    phone = F.concat(lead, (at(F.lit(30)) % 8 + 2).cast("string"), shape(F.substr(rest, F.lit(2))), digits)
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), shape(F.substr(canon, F.lit(2), F.length(canon) - 2)), digits)
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(body, F.when(cls == "luhn", check.cast("string")).otherwise(pick("0123456789", F.lit(29))))
    octet = lambda i, low, n: (at(F.lit(i)) % n + low).cast("string")
    inside = F.when((cls != "") & (attempt >= 8), "10").otherwise(cls)
    kept = F.size(F.split(inside, r"\."))
    net = F.when(cls == "", F.concat_ws(".", octet(0, 11, 116), octet(1, 0, 256), octet(2, 0, 256))).when(kept == 1, F.concat_ws(".", inside, octet(1, 0, 256), octet(2, 0, 256))).otherwise(F.concat_ws(".", inside, octet(2, 0, 256)))
    ip = F.when(attempt < 16, F.concat_ws(".", net, octet(3, 1, 254))).otherwise(local6)

    def name(consonants: str, vowels: str, ends: dict[str, str], gender: Column) -> Column:
        n = at(F.lit(20)) % 2 + 1 + F.floor(attempt / 2).cast("int")
        sounds = F.array_join(F.transform(F.sequence(F.lit(0), F.least(n, F.lit(9))), lambda i: F.concat(pick(consonants, i * 2), pick(vowels, i * 2 + 1))), "")
        end = pick(ends["n"], F.lit(21))
        for g in ("m", "f"):
            end = F.when(gender == g, pick(ends[g], F.lit(21))).otherwise(end)
        return F.concat(sounds, end)

    script, gender = F.substr(cls, F.length(cls), F.lit(1)), F.when(kind == "given", F.substr(cls, F.lit(1), F.lit(1))).otherwise("n")
    names = (
        F.when(script == "c", name("бвгдзклмнпрст", "аеиоу", {"m": "нрсмв", "f": "а", "n": "о"}, gender))
        .when(script == "g", name("βγδκλμνπρστφ", "αειου", {"m": "ς", "f": "α", "n": "ω"}, gender))
        .otherwise(name("bdfghjklmnprstvz", "aeiou", {"m": "nrsdl", "f": "a", "n": "y"}, gender))
    )
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip)
        .when(kind.isin("given", "surname"), names).when((kind == "ip6") & (attempt >= 8), local6).when(kind == "ssn", F.concat(shape(canon), digits))
        .otherwise(F.concat(F.when(cls == "hex", spelled(True)).otherwise(spelled(False)), F.when(kind == "ip6", "").otherwise(more)))
    )


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """kind, cls, canon -> sur, distinct within a kind and never an original of it.

    One row for each distinct part; a round redraws the few that collide.
    """
    state = settle(parts.withColumn("attempt", F.lit(0)).withColumn("sur", candidate(key, F.col("kind"), F.col("cls"), F.col("canon"), F.lit(0))), "surrogates")
    originals = state.select("kind", F.col("canon").alias("sur"), F.lit(True).alias("taken")).distinct()
    while True:  # candidates grow with the attempts, so the rounds end
        again = F.row_number().over(W.partitionBy("kind", "sur").orderBy("attempt", "canon", "cls")) > 1
        checked = state.withColumn("again", again).join(originals, ["kind", "sur"], "left").withColumn("again", F.col("again") | F.col("taken").isNotNull())
        if checked.where("again").isEmpty():
            return state.drop("attempt")
        attempt = F.col("attempt") + F.col("again").cast("int")
        drawn = F.when(F.col("again"), candidate(key, F.col("kind"), F.col("cls"), F.col("canon"), attempt)).otherwise(F.col("sur"))
        state = settle(checked.select("kind", "cls", "canon", attempt.alias("attempt"), drawn.alias("sur")), "surrogates")


def _written(raw: Column, kind: Column, sur: Column) -> Column:
    """``sur`` in the format of ``raw``; digits that ``raw`` has no place for follow it."""
    filled = F.aggregate(
        F.split(raw, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda a, c: F.struct(
            F.concat(a["out"], F.when(c.rlike("[0-9]"), F.substr(_digits(sur), a["i"], F.lit(1))).otherwise(c)).alias("out"),
            (a["i"] + c.rlike("[0-9]").cast("int")).alias("i"),
        ),
    )
    filled = F.transform(F.array(filled), lambda a: F.concat(a["out"], F.substr(_digits(sur), a["i"])))[0]
    cased = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(sur)).otherwise(sur)
    word = F.when((raw == F.upper(raw)) & (F.length(raw) > 2), F.upper(sur)).otherwise(F.initcap(sur))
    return (
        F.when(kind == "", raw).when(kind.isin("phone", "card", "ssn"), filled).when(kind.isin("email", "ip6"), cased)
        .when(kind.isin("given", "surname"), word).when((kind == "secret") & raw.rlike("^[0-9A-F]+$"), F.upper(sur)).otherwise(sur)
    )


def anonymise(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with the text replaced, and the number of mentions in ``count_col``.

    Null and empty texts, and texts without mentions, are unchanged with count
    0; repeated rows stay and read alike; other columns pass through (one
    named ``count_col`` is replaced). An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c != count_col]
    row = docs.select(F.struct(*own).alias("row"), F.col(text_col).alias("text"))
    has = may_mention(F.col("text"))
    keys = [F.xxhash64("text", F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2")]
    hit = row.where(has).withColumn("found", mentions(F.col("text"))).select("*", *keys)
    slim = hit.select("k1", "k2", F.transform(_parts(F.col("found"), F.lit("")), lambda p: F.struct(p["kind"].alias("kind"), p["cls"].alias("cls"), p["canon"].alias("canon"))).alias("parts"))
    texts = settle(slim.where(F.size("parts") > 0).groupBy("k1", "k2").agg(F.first("parts").alias("parts")), "mentions")
    flat = texts.select("k1", "k2", F.posexplode("parts").alias("pos", "p")).select("k1", "k2", "pos", "p.*").where("kind <> ''")
    # a given name has one gender throughout the corpus, the one that most of its mentions show
    flat = flat.withColumn("group", F.when(F.col("kind") == "given", F.substr("cls", F.lit(2))).otherwise(F.col("cls")))
    shows = lambda g: F.count_if((F.col("kind") == "given") & F.col("cls").startswith(g))
    votes = flat.groupBy("kind", "group", "canon").agg(shows("m").alias("m"), shows("f").alias("f"))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("m") < F.col("f"), "f").otherwise("n")
    votes = votes.select("kind", F.when(F.col("kind") == "given", F.concat(gender, "group")).otherwise(F.col("group")).alias("cls"), "canon")
    known = surrogates(votes, key).withColumn("group", F.when(F.col("kind") == "given", F.substr("cls", F.lit(2))).otherwise(F.col("cls"))).drop("cls")
    subs = flat.join(known, ["kind", "group", "canon"]).groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("pos", "sur"))).alias("subs"))
    parts = _parts(F.col("found"), F.col("text"))
    new = F.transform(parts, lambda p, i: F.concat(p["before"], _written(p["raw"], p["kind"], F.coalesce(F.try_element_at(F.col("subs"), i), F.lit("")))))
    tail = F.element_at(F.split(F.col("text"), ANY), -1)
    done = hit.join(subs, ["k1", "k2"], "left").select(
        *(F.concat(F.array_join(new, ""), tail).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in own), F.size("found").alias(count_col)
    )
    rest = row.where(~has).select(*(F.col("row")[c].alias(c) for c in own), F.lit(0).alias(count_col))
    return rest.unionByName(done)
