"""Personal data: detected entities get keyed surrogates of their own kind.

Mentions are found by patterns: addresses of mail, secrets, bank, card, social and phone
numbers, IP addresses, streets, and names, which are told by what stands around them (a
title, a greeting, a word like "met" or "named", a mail address after them) or by a
given name. A number in the shape of a card that fails its check digit is none.

Equal entities, however written, share a canonical form and so a surrogate; the
surrogate keeps the mention's format, case, script, country code, check digits and, for
names, gender. Surrogates come from a keyed hash and are checked over the whole corpus:
no two entities share one and none is an entity of the input, else the later entity
draws again. A person is a first name with a surname: the first names of one surname
are told apart, while persons of different surnames may share one. All of it is Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.checkpoints import cut

# First names by gender and script, titles by gender, words that are no surname, words before a name.
FIRST = {
    ("m", "latin"): [
        "James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Paul", "Mark", "George", "Peter", "Hans", "Karl", "Pierre", "Jean", "Carlos", "Juan", "Miguel", "Pedro",
        "Kofi", "Ahmed", "Omar", "Hassan", "Ibrahim", "Yusuf", "Wei", "Hiroshi", "Kenji", "Rahul", "Arjun", "Sanjay", "Luca", "Marco", "Giovanni", "Lars", "Sven", "Piotr", "Andrzej", "Kwame",
    ],
    ("f", "latin"): [
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Nancy", "Lisa", "Margaret", "Sandra", "Greta", "Heidi", "Camille", "Sophie", "Carmen", "Lucia", "Maria", "Elena",
        "Aisha", "Fatima", "Leila", "Zainab", "Mei", "Yuki", "Sakura", "Priya", "Ananya", "Lakshmi", "Giulia", "Chiara", "Francesca", "Ingrid", "Astrid", "Agnieszka", "Katarzyna", "Amara", "Ngozi", "Abena",
    ],
    ("m", "cyrillic"): ["Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Николай", "Павел", "Андрей"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
}
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora"], "u": ["Dr", "Prof"]}
NO_NAMES = ["A", "All", "Also", "An", "And", "Are", "As", "At", "But", "By", "Can", "For", "From", "Had", "Has", "Have", "He", "Her", "His", "How", "I", "If", "In", "Is", "It", "Its", "My", "No", "Not", "Of", "On", "Or", "Our", "She", "So", "That", "The", "Their", "They", "This", "To", "Us", "Was", "We", "Were", "When", "Who", "Will", "With", "You", "Your", "New", "San", "Los", "Las", "Valued", "Customer", "Customers", "Sir", "Madam", "Team", "Support", "Sales", "Office", "Department", "Service", "University", "Station", "Street", "Avenue", "Ave", "Road", "Rd", "Boulevard", "Blvd", "Drive", "Square", "Terrace"]
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "la", "le", "ten", "ter", "bin", "ibn", "el", "al"]
CUES = ["met", "met with", "contact", "Contact", "contact:", "Contact:", "Dear", "Hello", "Hi", "named", "called", "name is", "name:", "Name:", "author:", "Author:", "Attn:", "signed", "Signed", "Sincerely,", "Regards,", "regards,", "I am", "I'm", "spoke to", "spoke with", "ask for", "interview with", "interviewed"]
STREETS = ["Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Boulevard", "Blvd", "Drive", "Court", "Square", "Terrace"]
SYLLABLES = {
    "latin": ["bar", "bel", "cor", "dal", "den", "fer", "gar", "hol", "kel", "lan", "lor", "mar", "mel", "nor", "par", "ram", "sel", "tor", "val", "wen", "win", "yor", "zan", "hart"],
    "cyrillic": ["бар", "вел", "гор", "дан", "зар", "кол", "лен", "мар", "нов", "пет", "рам", "сол", "тар", "фед", "чер", "шум"],
}
ALPHABETS = {"0123456789": "0-9", "abcdefghijklmnopqrstuvwxyz": "a-z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ": "A-Z", "абвгдежзийклмнопрстуфхцчшщыэюя": "а-яё", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ": "А-ЯЁ"}
#: Country codes of one and two digits; all others have three.
SHORT_CODES = r"1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Endings of Slavic surnames that take an "а" for women.
_HIS = "(?:ов|ев|ёв|ин)"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)"
_GIVEN = "|".join(n for names in FIRST.values() for n in names)
_SHOUTED = "|".join(n.upper() for names in FIRST.values() for n in names)
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
_WORD = r"\p{Lu}[\p{L}'’-]+"
_SURNAME = rf"(?!(?:{'|'.join(NO_NAMES)})(?![\p{{L}}'’-])){_WORD}"
_CAPS = rf"(?!(?:{'|'.join(w.upper() for w in NO_NAMES)})(?![\p{{L}}'’-]))\p{{Lu}}[\p{{Lu}}'’-]+(?!\p{{L}})"
_OF = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
_CUE = "|".join(CUES)
_STREET = "|".join(STREETS)
_HEX = "[0-9A-Fa-f]{1,4}"
#: By kind, in order of precedence at one place of a text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,255}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63})+",
    "secret": r"""(?<=[=:"'\s])(?<=[=:]\s{0,3}["']?)(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?)[A-Za-z0-9+/_.~-]{8,}=*|(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9_])(?:ghp_|sk-|xox[abp]-)[A-Za-z0-9_-]{16,}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|(?<=-)(?<=PRIVATE KEY-----\s{0,2})[A-Za-z0-9+/=\s]{16,}(?=-----END)""",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": rf"(?<![\w:.])(?=[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f:]{{3}})(?=[A-Fa-f:]{{0,36}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\w:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|\d{3} \d{2} \d{4}(?!\d)(?<=(?i:ssn|social security number)[ :#]{1,3}\d{3} \d{2} \d{4})",
    "phone": r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\d+.-])1[.-]\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\d+.-])0\d{2} \d{4} \d{4}(?!\d)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "street": rf"(?<![\p{{L}}\p{{N}}.,])\d{{1,5}} (?:\p{{Lu}}\p{{Ll}}+ ){{1,3}}(?:{_STREET})(?![\p{{L}}\p{{N}}])",
    "card": r"(?<![\d.])\d{4}(?:[ -]\d{4}){3}(?!\d)|(?<![\d.])3[47]\d{2}[ -]\d{6}[ -]\d{5}(?!\d)|(?<![\d.])\d{13,19}(?!\d)",
    "name": (
        rf"(?=[A-ZА-ЯЁ])(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? (?:{_SURNAME} )?{_OF}{_SURNAME}|(?:{_GIVEN}) {_OF}{_SURNAME}|(?:{_SHOUTED}) {_CAPS}"
        rf"|(?<=(?<![\p{{L}}\p{{N}}])(?:{_CUE}) ){_SURNAME} {_SURNAME}|{_SURNAME} {_SURNAME}(?= [<(][^\s@<>()]{{1,64}}@))"
    ),
}
_NUMBERS = ("ssn", "phone", "ip", "street", "card")
#: One pattern for all. What starts with a digit, + or ( is looked at only there.
ANY = "|".join([*(f"(?:{PATTERNS[k]})" for k in ("email", "secret", "iban", "ip6")), rf"(?=[\d+(])(?:{'|'.join(PATTERNS[k] for k in _NUMBERS)})", f"(?:{PATTERNS['name']})"])
#: A text without a digit, an @, one of these words or, after two capitals, one of these names has no entity.
HINT_WORDS = ["password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey", "ghp_", "sk-", "xox", "akia", "asia", "eyj", "private key"]
HINT_CAPITALS = rf"\p{{Lu}}[\p{{L}}'’-]+\.? {_OF}\p{{Lu}}"
HINT_NAMES = rf"(?<![\p{{L}}\p{{N}}])(?:(?=[A-ZА-ЯЁ])(?:{_TITLE}|{_GIVEN}|{_SHOUTED})\.? |(?:{_CUE}) {_WORD} )"


def hinted(text: Column) -> Column:
    """Whether a text can have an entity at all; far cheaper than looking for one."""
    low, out = F.lower(text), text.rlike("[0-9@]")
    for w in HINT_WORDS:
        out = out | F.contains(low, F.lit(w))
    return out | (text.rlike(HINT_CAPITALS) & text.rlike(HINT_NAMES))


def mentions(text: Column) -> Column:
    """The entities of a text as written, in order, repeats included; with them numbers like those of cards."""
    none = F.array().cast("array<string>")
    return F.when(hinted(text), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(none)


def kind_of(mention: Column) -> Column:
    out = F.when(mention.rlike("@"), F.lit("email")).when(mention.rlike(r"^\d{3} \d{2} \d{4}$"), F.lit("ssn"))
    for kind in ("iban", "ssn", "phone", "ip", "card"):
        out = out.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind))
    out = out.when(mention.rlike("^[0-9A-Fa-f]+:[0-9A-Fa-f:]+$"), F.lit("ip6")).when(mention.rlike(f"^{PATTERNS['street']}$"), F.lit("street"))
    # a name was told by what stands around it, and has two words at least; a secret has no space
    return out.when(mention.rlike(rf"^(?:(?:{_TITLE})\.? )?(?:{_WORD} )?{_OF}{_WORD}$") & F.contains(mention, F.lit(" ")), F.lit("name")).otherwise(F.lit("secret"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def entity(mention: Column) -> Column:
    """Whether what mentions() found is one: digits in the shape of a card need its check digit."""
    return ~mention.rlike(f"^(?:{PATTERNS['card']})$") | (luhn(_digits(mention)) % 10 == 0)


def iban_check(iban: Column) -> Column:
    """The two check digits of an IBAN without spaces, whatever it holds there."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(2)), F.lit("00"))

    def step(r, i):
        c = F.substring(turned, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55) % 97

    return F.lpad((98 - F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)).cast("string"), 2, "0")


def _his(surname: Column) -> Column:
    """A surname in lower case, in its masculine form."""
    return F.regexp_replace(F.lower(surname), f"({_HIS})а$", "$1")


def _parts(mention: Column, kind: Column) -> Column:
    """(kind, canonical form, as written) of what is replaced on its own in a mention."""
    part = lambda k, canon, raw: F.struct(k.alias("kind"), canon.alias("canon"), raw.alias("raw"))
    d = _digits(mention)
    canon = (
        F.when(kind.isin("email", "ip6"), F.lower(mention))
        .when(kind == "phone", F.when(mention.startswith("+") | d.startswith("0") | ((F.length(d) == 11) & d.startswith("1")), d).otherwise(F.concat(F.lit("1"), d)))
        .when(kind.isin("card", "ssn"), d)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(mention)
    )
    words = F.split(mention, " ")
    title = F.regexp_replace(words[0], r"\.$", "")
    titled = title.isin([t for ts in TITLES.values() for t in ts])
    # a neutral title says nothing of the gender, the given name after it may
    given = F.lower(F.when(titled, F.get(words, F.lit(1))).otherwise(words[0]))
    last = F.element_at(words, -1)
    listed = lambda sex: given.isin([n.lower() for (g, _), ns in FIRST.items() if g == sex for n in ns])
    gender = F.when(title.isin(TITLES["m"]), F.lit("m")).when(title.isin(TITLES["f"]), F.lit("f")).when(listed("m"), F.lit("m")).when(listed("f"), F.lit("f")).when(F.lower(last).rlike(f"{_HIS}а$"), F.lit("f")).otherwise(F.lit("u"))

    def word(w, i):
        k = F.when(((i == 0) & titled) | w.isin(PARTICLES), F.lit("title")).when(i < F.size(words) - 1, F.concat(F.lit("first_"), gender)).otherwise(F.lit("surname"))
        whole = F.concat_ws(" ", F.lower(w), _his(last))
        return part(k, F.when(k == "title", w).when(k == "surname", _his(w)).otherwise(whole), w)

    return F.when(kind == "name", F.transform(words, word)).otherwise(F.array(part(kind, canon, mention)))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The attempt-th surrogate of an entity, in canonical form."""
    blocks = F.sequence(F.lit(0), F.floor(F.length(canon) / 32).cast("int") + 1)
    stream = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), b.cast("string"), canon), 512)), "")
    # bound by the lambda, so that the digest isn't computed for every character
    return F.get(F.transform(F.array(stream), lambda s: _drawn(kind, canon, attempt, s)), F.lit(0))


def _drawn(kind: Column, canon: Column, attempt: Column, stream: Column) -> Column:
    """A surrogate from the hex digits of a keyed digest, two for each character."""
    byte = lambda i: F.conv(F.substring(stream, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda letters, b: F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1))
    script = lambda c: F.when(c.rlike("[Ѐ-ӿ]"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    code = F.when(canon.rlike(f"^(?:{SHORT_CODES[:3]})"), 1).when(canon.rlike(f"^(?:{SHORT_CODES})"), 2).otherwise(3)
    keep = F.when(kind == "card", 1).when(kind == "phone", code).when(kind == "iban", 4).when((kind == "secret") & canon.rlike("^(?:AKIA|ASIA|ghp_|xox)"), 4).when((kind == "secret") & canon.rlike("^(?:sk-|eyJ)"), 3).otherwise(0)
    hexadecimal = canon.rlike("^[0-9a-f]+$") | (kind == "ip6")
    at = F.length(canon) - F.length(F.substring_index(canon, "@", -1))  # place of the @, 0 without one
    top = F.length(canon) - F.length(F.substring_index(canon, ".", -1))

    def char(i):
        c, b = F.substring(canon, i, F.lit(1)), byte(i)
        out = F.when((i <= keep) | ((kind == "email") & (i > top)), c).when((kind == "phone") & (F.length(canon) == 11) & canon.startswith("1") & i.isin(2, 5), pick("23456789", b))
        for letters, span in ALPHABETS.items():
            new = pick(letters, b)
            if span == "a-z":
                new = F.when(hexadecimal, pick("abcdef", b)).otherwise(new)
            out = out.when(c.rlike(f"^[{span}]$"), new)
        return out.otherwise(c)

    like = F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), char), "")
    # a short local part may run out of forms: from the third attempt on it grows
    more = F.when(attempt >= 2, F.translate(F.substring(stream, F.lit(65), attempt), "abcdef", "012345")).otherwise(F.lit(""))
    email = F.concat(F.substring(like, F.lit(1), at - 1), more, F.substring(like, at, F.length(canon)))
    body = F.substring(like, F.lit(1), F.length(canon) - 1)
    card = F.when(luhn(canon) % 10 == 0, F.concat(body, ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))).otherwise(like)
    address = F.concat_ws(".", (byte(F.lit(1)) % 223 + 1).cast("string"), byte(F.lit(2)).cast("string"), byte(F.lit(3)).cast("string"), (byte(F.lit(4)) % 254 + 1).cast("string"))

    def given(gender):
        own = F.substring_index(canon, " ", 1)

        def drawn(names):
            pool = F.array(*[F.lit(n) for n in names])
            at = lambda i: byte(i) % len(names)
            one = lambda i: F.when(F.lower(F.get(pool, at(i))) == own, F.get(pool, (at(i) + 1) % len(names))).otherwise(F.get(pool, at(i)))
            # a surname may have more first names than the pool: every eighth attempt takes one more
            return F.array_join(F.transform(F.sequence(F.lit(1), 1 + F.floor(attempt / 8).cast("int")), one), "-")

        pools = [drawn([n for (g, x), ns in FIRST.items() if x == s and gender in (g, "u") for n in ns]) for s in ("latin", "cyrillic")]
        return F.when(script(own) == "cyrillic", pools[1]).otherwise(pools[0])

    def made(s, first, count):
        pool = F.array(*[F.lit(x) for x in SYLLABLES[s]])
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.get(pool, byte(first + i) % len(SYLLABLES[s]))), ""))

    more_often = F.floor(attempt / 2).cast("int")
    his = F.when(canon.rlike(f"{_HIS}$"), F.lit("ов")).otherwise(F.lit(""))
    surname = F.when(script(canon) == "cyrillic", F.concat(made("cyrillic", F.lit(0), F.lit(3) + more_often), his)).otherwise(made("latin", F.lit(0), F.lit(3) + more_often))
    words = F.split(canon, " ")
    number = F.substring(like, F.lit(1), F.length(words[0]))
    number = F.when(number.startswith("0"), F.concat(F.lit("1"), F.substring(number, F.lit(2), F.length(number)))).otherwise(number)
    named = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: made("latin", 6 * i, F.lit(3) + more_often))
    street = F.array_join(F.concat(F.array(number), named, F.array(F.element_at(words, -1))), " ")
    iban = F.concat(F.substring(like, F.lit(1), F.lit(2)), iban_check(like), F.substring(like, F.lit(5), F.length(canon)))

    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", address).when(kind == "title", canon)
        .when(kind == "first_m", given("m")).when(kind == "first_f", given("f")).when(kind == "first_u", given("u"))
        .when(kind == "surname", surname).when(kind == "street", street).when(kind == "iban", iban)
        .otherwise(like)
    )


def _formatted(kind: Column, raw: Column, new: Column) -> Column:
    """A surrogate in the format of a mention: separators, country code and case."""
    d = _digits(raw)
    spare = F.length(d) - F.length(new)  # digits of a country code, which stay

    def char(i):
        c = F.substring(raw, i, F.lit(1))
        nth = F.length(_digits(F.substring(raw, F.lit(1), i)))
        return F.when(c.rlike(r"^\d$") & (nth > spare), F.substring(new, nth - spare, F.lit(1))).otherwise(c)

    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), char), "")

    def group(i):
        c = F.substring(raw, i, F.lit(1))
        return F.when(c == " ", c).otherwise(F.substring(new, F.length(F.replace(F.substring(raw, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))

    iban = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), group), "")
    lettered = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    own_case = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(lettered(F.substring(raw, i, F.lit(1))), F.upper(F.substring(new, i, F.lit(1)))).otherwise(F.substring(new, i, F.lit(1)))), "")
    hers = F.when((kind == "surname") & F.lower(raw).rlike(f"{_HIS}а$"), F.concat(new, F.lit("а"))).otherwise(new)
    cased = F.when(kind.isin("email", "ip6") & (F.length(raw) == F.length(new)), own_case).when(lettered(raw) & kind.isin("email", "surname", "first_m", "first_f", "first_u"), F.upper(hers)).otherwise(hers)
    return F.when(kind.isin("phone", "card", "ssn"), spaced).when(kind == "iban", iban).otherwise(cased)


def assign(entities: DataFrame, key: str, most: int = 40) -> DataFrame:
    """(kind, canon) -> (kind, canon, new): distinct surrogates, none of them an input.

    The canonical form of a first name is the full name; its surrogate differs from those
    of the other first names, of any gender, with that surname. As no surname becomes one
    of the input, no full name does, and the surrogate itself may be a name of the input.
    Titles stay. Where a kind has nearly as many entities as it has forms (say over a
    billion distinct social security numbers), ``most`` rounds don't part them all, and
    that is a ValueError, never a shared surrogate.
    """
    entities = cut(entities.distinct())
    first = F.col("kind").startswith("first_")
    free = F.col("kind") == "title"
    scope = F.when(first, F.concat(F.lit("first|"), F.substring_index("canon", " ", -1))).otherwise(F.col("kind"))
    now = cut(entities.withColumn("attempt", F.lit(0)).withColumn("new", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)))
    for _ in range(most):
        # of those with one surrogate, the one that has held it longest keeps it
        now = now.withColumn("scope", scope)
        owner = now.groupBy("scope", "new").agg(F.min(F.struct("attempt", "canon", "kind")).alias("own"))
        real = entities.select("kind", F.col("canon").alias("new"), F.lit(True).alias("real"))
        lowered = now.withColumn("seen", F.when(F.col("kind") == "surname", F.lower("new")).otherwise(F.col("new")))
        judged = lowered.join(owner, ["scope", "new"]).join(real.withColumnRenamed("new", "seen"), ["kind", "seen"], "left")
        taken = (F.col("own.canon") != F.col("canon")) | (F.col("own.kind") != F.col("kind"))
        again = ~free & ((F.col("real").isNotNull() & ~first) | taken)
        now = cut(judged.select("kind", "canon", "new", F.col("attempt"), again.alias("again")))
        if now.where("again").isEmpty():
            return now.select("kind", "canon", "new")
        next_ = F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        now = now.select("kind", "canon", next_.alias("attempt"), "again", "new")
        now = cut(now.select("kind", "canon", "attempt", F.when(F.col("again"), surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)).otherwise(F.col("new")).alias("new")))
    raise ValueError("a kind of entity has more values than forms for its surrogates")


def one_gender(parts: DataFrame) -> DataFrame:
    """The parts of mentions, a full name of unknown gender taking the one it has elsewhere, if only one."""
    unknown = F.col("kind") == "first_u"
    told = parts.where(F.col("kind").isin("first_m", "first_f")).groupBy("canon").agg(F.min("kind").alias("least"), F.max("kind").alias("most"))
    told = told.where(F.col("least") == F.col("most")).select("canon", F.col("least").alias("told"))
    found = parts.where(unknown).join(told, "canon", "left").withColumn("kind", F.coalesce("told", "kind"))
    return parts.where(~unknown).unionByName(found.select(*parts.columns))


def replace_entities(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows of docs with the entities of their texts replaced.

    All columns stay, in order and whatever their names; ``count_col`` adds the number of
    mentions replaced. The same entity gets the same surrogate in every row and for
    every run with one key and corpus. Null and empty texts stay as they are, long ones
    are searched whole, rows are neither lost nor merged, and ids play no part, so null
    and repeated ids are fine; an empty table gives no rows. A single name, a name in
    running text without a given name or a word that tells it, and dates stay: days of
    birth are fewer than people. See assign() for the one error there is.
    """
    cols = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))  # so that no name of theirs clashes
    text = F.col("row")[text_col]
    found = mentions(text)
    hash_ = F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), F.length(text).alias("n"))
    # a generator, so that a filter on the result isn't computed a second time
    some = F.filter(F.array(found), lambda a: F.exists(a, entity))
    plain = held.where(text.isNull() | ~F.exists(found, entity))
    marked = held.where(text.isNotNull()).select("*", F.explode(some).alias("found")).withColumn("hash", hash_)
    uses = cut(marked.select("hash", F.explode(F.array_distinct("found")).alias("mention")).where(entity(F.col("mention"))).distinct())
    parts = uses.select("mention").distinct().withColumn("kind", kind_of(F.col("mention")))
    parts = cut(parts.select("mention", F.posexplode(_parts(F.col("mention"), F.col("kind"))).alias("at", "part")).select("mention", "at", "part.*"))
    parts = cut(one_gender(parts))
    named = parts.join(assign(parts.select("kind", "canon"), key), ["kind", "canon"])
    named = named.withColumn("shown", _formatted(F.col("kind"), F.col("raw"), F.col("new")))
    shown = named.groupBy("mention").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda p: p["shown"]), " ").alias("shown"))
    maps = uses.join(shown, "mention").groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("mention", "shown"))).alias("map"))
    joined = marked.join(maps, "hash")
    between = F.split(text, ANY, -1)
    new = F.concat(F.transform("found", lambda m: F.coalesce(F.element_at(F.col("map"), m), m)), F.array(F.lit("")))
    out = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, b)), "")
    own = lambda c: F.col("row")[c].alias(c)
    n = F.size(F.filter("found", lambda m: F.array_contains(F.map_keys("map"), m))).cast("long")
    count = [] if count_col is None else [count_col]
    done = joined.select(*[out.alias(c) if c == text_col else own(c) for c in cols], *[n.alias(c) for c in count])
    return plain.select(*[own(c) for c in cols], *[F.lit(0).cast("long").alias(c) for c in count]).unionAll(done)
