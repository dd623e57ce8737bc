"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent over all documents.

Entities are found with one pattern, in one pass. Each distinct entity gets a replacement from a keyed hash;
replacements that two entities share, or that equal an entity of the corpus, are drawn again, and longer ones after
some attempts, so that the drawing ends. Mentions of one entity get one replacement, written in the mention's own
format. Check digits are valid where they were. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .\-]\d{2,4}){2,5}(?!\d)|(?<![\w\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<![\w.])(?:\d{4}[ \-]?){3}\d{1,7}(?!\w)|(?<![\w.])\d{13,19}(?!\w)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,19}(?![A-Za-z0-9])"
MEN = r"Mr|Herr|M|Monsieur|Sr|Señor|Don|Г-н|Господин|Κύριος"
WOMEN = r"Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Sra|Srta|Señora|Doña|Г-жа|Госпожа|Κυρία"
TITLE = rf"(?:{MEN}|{WOMEN}|Dr|Prof)\.?\x20"
#: Given names that make a name of what follows even without a title.
KNOWN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Andrew George Kenneth Adam Peter Paul Hans Karl Klaus Jürgen Wolfgang Stefan Jean Pierre Michel Philippe Luc Carlos José Juan Luis Miguel Pedro Иван Пётр Сергей Дмитрий Алексей Андрей Владимир Николай Γιώργος Νίκος Δημήτρης".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Emily Anna Maria Ursula Monika Sabine Petra Claudia Marie Sophie Camille Isabelle Nathalie Carmen Lucía Dolores Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Μαρία Ελένη Κατερίνα".split(),
}
_PART = r"\p{Lu}\p{L}*+(?:['’\-]\p{L}++)*+"
_KNOWN = "|".join(KNOWN["m"] + KNOWN["f"])
NAME = rf"(?<![\p{{L}}\d])(?=\p{{Lu}})(?:{TITLE}{_PART}|(?:{_KNOWN})\x20{_PART})(?:\x20{_PART})*+(?!\p{{L}})"
ENTITY = "|".join((EMAIL, IP, SSN, PHONE, CARD, IBAN, NAME))
#: What every entity but an e-mail address holds: a digit and five more characters of numbers, or a title or given name and a capital.
SIGN = rf"[0-9][0-9 .()\-]{{5}}|(?<![\p{{L}}\d])(?=\p{{Lu}})(?:{TITLE}|(?:{_KNOWN})\x20)\p{{Lu}}"
#: From this attempt on, a replacement is longer than what it replaces, by one more place in each further attempt.
LONGER = 8

#: Given names by script and gender, family names by script: Cyrillic ones take an "а" for women, Greek ones are the same for all.
#: A name that is drawn again gets syllables before its ending.
GIVEN = {
    ("latin", "m"): ["Adrian", "Bruno", "Conrad", "Dario", "Emil", "Felix", "Gregor", "Henri", "Ivo", "Jonas", "Kilian", "Leo", "Marius", "Nils", "Oscar", "Paul"],
    ("latin", "f"): ["Alma", "Bianca", "Clara", "Dina", "Elsa", "Flora", "Greta", "Helena", "Irma", "Julia", "Karin", "Livia", "Marta", "Nora", "Olga", "Petra"],
    ("latin", "n"): ["Alex", "Bo", "Charlie", "Dana", "Eden", "Finley", "Gale", "Harper", "Indigo", "Jamie", "Kim", "Luca", "Morgan", "Noa", "Quinn", "Robin"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Матвей", "Никита", "Олег", "Павел", "Роман", "Семён"],
    ("cyrillic", "f"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"],
    ("greek", "m"): ["Αλέξης", "Βασίλης", "Γιάννης", "Δήμος", "Θάνος", "Κώστας", "Λάκης", "Μάνος"],
    ("greek", "f"): ["Αγγελική", "Βάσω", "Γεωργία", "Δήμητρα", "Θάλεια", "Κατερίνα", "Λένα", "Μαρία"],
}
FAMILY = {
    "latin": ["Abbot", "Berger", "Castel", "Durand", "Egger", "Ferrer", "Gruber", "Holm", "Ibarra", "Janvier", "Keller", "Lindt", "Morel", "Navarro", "Ortega", "Pichler", "Quint", "Renard", "Serra", "Talbot", "Ulmer", "Vidal", "Weber", "Xenos", "Yates", "Zeller"],
    "cyrillic": ["Абрамов", "Белов", "Волков", "Громов", "Дубов", "Ершов", "Жуков", "Зимин", "Ильин", "Крылов", "Лапин", "Мухин"],
    "greek": ["Αλεξίου", "Βασιλείου", "Γεωργίου", "Δημητρίου", "Ιωάννου", "Νικολάου", "Παύλου", "Στεφάνου"],
}
_SYLLABLE = {"latin": ["ba", "den", "fil", "gor", "hal", "kin", "lo", "mer", "nos", "pal", "rin", "sten", "tor", "val", "wen", "zel"], "cyrillic": ["ба", "вен", "гор", "дин", "ко", "лан", "мир", "нов", "пол", "рин", "сан", "тов", "фил", "хан", "цев", "шин"], "greek": ["βα", "γο", "δι", "κα", "λο", "με", "νι", "πα", "ρο", "σα", "τι", "φα", "χο", "ψι", "ζα", "θε"]}


def _byte(h: Column, i: Column | int) -> Column:
    """The i-th byte of the hash, round and round."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(64)) * 2 + 1
    return F.conv(F.substr(h, at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _list(x: list) -> Column:
    return F.array(*[F.lit(v) for v in x])


def _drawn(text: Column, h: Column) -> Column:
    """The text with each ASCII letter and digit drawn anew from its own kind."""
    alphabet = {"[0-9]": "0123456789", "[aeiou]": "aeiou", "[a-z]": "bcdfghklmnprstvwz", "[A-Z]": "ABCDEFGHKLMNPRSTVWZ"}

    def one(c: Column, i: Column) -> Column:
        out = c
        for kind, letters in reversed(alphabet.items()):
            out = F.when(c.rlike(kind), F.substr(F.lit(letters), (_byte(h, i) % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind, p in reversed({"email": EMAIL, "ip": IP, "ssn": SSN, "phone": PHONE, "card": CARD, "iban": IBAN}.items()):
        out = F.when(mention.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """The sum of digits, from the last on each second one doubled, by 10; 0 for a valid number."""
    each = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """Digits and capitals (A is 10) as one number, by 97."""
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _by_97(iban: Column) -> Column:
    return _mod97(F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4)))


def pieces_of(mention: Column) -> Column:
    """What a mention consists of: (lead, own, kind, canon, woman); each word of a name is an entity by itself.

    A Russian woman's family name has its man's form as canon, so the two stay one name.
    """
    return _let(kind_of(mention), lambda kind: _let(F.regexp_extract(mention, rf"^{TITLE}", 0), lambda title: _pieces(mention, kind, title)))


def _pieces(mention: Column, kind: Column, title: Column) -> Column:
    words = F.split(F.substr(mention, F.length(title) + 1), r"\x20")
    first = F.element_at(words, 1)
    gender = F.when(title.rlike(rf"^(?:{MEN})\.?\x20$") | ((title == "") & first.isin(KNOWN["m"])), "m").when(title.rlike(rf"^(?:{WOMEN})\.?\x20$") | ((title == "") & first.isin(KNOWN["f"])), "f").otherwise("n")
    part = lambda lead, own, kind, canon, woman: F.struct(lead.alias("lead"), own.alias("own"), kind.alias("kind"), canon.alias("canon"), woman.alias("woman"))

    def word(own: Column, i: Column) -> Column:
        lead, ending, script = F.when(i == 0, title).otherwise(" "), own.rlike("(?i)(ов|ев|ёв|ин)а$"), script_of(own)
        given = part(lead, own, F.concat(F.lit("given "), script, F.lit(" "), gender), F.initcap(own), F.lit(False))
        canon = F.initcap(F.when(ending, F.substr(own, F.lit(1), F.length(own) - 1)).otherwise(own))
        family = part(lead, own, F.concat(F.lit("family "), script), canon, (script == "cyrillic") & (ending | (gender == "f")))
        return F.when(i == F.size(words) - 1, family).otherwise(given)

    canon = F.when(kind.isin("ssn", "phone", "card"), F.regexp_replace(mention, "[^0-9]", "")).when(kind == "email", F.lower(mention)).otherwise(mention)
    return F.when(kind != "name", F.array(part(F.lit(""), mention, kind, canon, F.lit(False)))).otherwise(F.transform(words, word))


def _name(kind: Column, h: Column, attempt: Column) -> Column:
    script = F.element_at(F.split(kind, " "), 2)
    gender = F.element_at(F.split(kind, " "), -1)
    pick = lambda x, i: F.element_at(_list(x), (_byte(h, i) % len(x) + 1).cast("int"))
    out = F.lit("")
    for s, names in FAMILY.items():
        out = F.when(kind.startswith("family") & (script == s), pick(names, 0)).otherwise(out)
    for s in FAMILY:
        for g in ("m", "f", "n"):
            out = F.when(kind.startswith("given") & (script == s) & (gender == g), pick(GIVEN.get((s, g)) or GIVEN[s, "m"] + GIVEN[s, "f"], 0)).otherwise(out)
    more = F.lit("")
    for s, x in _SYLLABLE.items():
        more = F.when(script == s, F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda i: F.element_at(_list(x), (_byte(h, i + 1) % len(x) + 1).cast("int"))), "")).otherwise(more)
    return F.when(attempt > 0, F.concat(F.substr(out, F.lit(1), F.length(out) - 2), more, F.right(out, F.lit(2)))).otherwise(out)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity in its canonical form; another for each attempt."""
    h = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)
    hd = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1)).cast("binary"), 512)
    return _let(h, lambda h: _let(hd, lambda hd: _surrogate(kind, canon, attempt, h, hd)))


def _surrogate(kind: Column, canon: Column, attempt: Column, h: Column, hd: Column) -> Column:
    some = lambda n: F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (_byte(h, i + 40) % 10).cast("string")), "")).otherwise("")
    domain = F.substring_index(canon, "@", -1)
    host = F.regexp_replace(domain, r"\.[^.]*$", "")
    mail = F.concat(_drawn(F.substring_index(canon, "@", 1), h), some(attempt), F.lit("@"), _drawn(host, hd), F.substr(domain, F.length(host) + 1))
    more = some(attempt - (LONGER - 1))
    octets = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(h, i) % 254 + 1).cast("string")), "."), F.when(more != "", F.concat(F.lit("-"), more)).otherwise(""))
    country = F.substring(canon, 1, 2)
    account = F.concat(_drawn(F.substr(canon, F.lit(5)), h), more)
    check = F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(_by_97(canon) == 1, check).otherwise(_drawn(F.substring(canon, 3, 2), F.reverse(h))), account)
    digits = F.concat(_drawn(canon, h), more)
    card = F.concat(F.left(canon, F.lit(1)), F.substr(digits, F.lit(2)))
    body = F.substr(card, F.lit(1), F.length(card) - 1)
    card = F.when(_luhn(canon) == 0, F.concat(body, ((F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))).otherwise(card)
    return F.when(kind == "email", mail).when(kind == "ip", octets).when(kind == "iban", iban).when(kind == "card", card).when(kind.isin("ssn", "phone"), digits).otherwise(_name(kind, h, attempt))


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for distinct (kind, canon): no two of a kind share one, none equals an entity of its kind.

    Each round draws again for those that clash. Mailboxes and names get longer at once, the other kinds from the
    attempt LONGER on, so however full a format's space is, there is room in the end.
    """
    state = entities.withColumn("attempt", F.lit(0))
    while True:
        state = stored(state.select("kind", "canon", "attempt", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key).alias("surrogate")), "surrogates")
        first = state.groupBy("kind", "surrogate").agg(F.min("canon").alias("owner"))
        real = entities.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        checked = state.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        clash = (F.col("owner") != F.col("canon")) | F.col("real").isNotNull()
        checked = stored(checked.select("kind", "canon", "attempt", clash.alias("clash")), "clashes")
        if not checked.filter("clash").head(1):
            return state.select("kind", "canon", "surrogate")
        state = checked.select("kind", "canon", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))


def _written(own: Column, kind: Column, new: Column, woman: Column) -> Column:
    """The surrogate in the mention's format: digits go where digits were, capitals stay, a woman's name has its ending."""
    digits = F.array_join(F.transform(F.split(own, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(new, F.length(F.regexp_replace(F.substr(own, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")
    digits = F.concat(digits, F.substr(new, F.length(F.regexp_replace(own, "[^0-9]", "")) + 1))
    new = F.when(woman, F.concat(new, F.lit("а"))).otherwise(new)
    capitals = ~kind.isin("ip", "iban") & (own == F.upper(own)) & (own != F.lower(own)) & (F.length(own) > 1)
    return F.when(kind.isin("ssn", "phone", "card"), digits).when(capitals, F.upper(new)).otherwise(new)


def with_surrogates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the entities in text replaced, and n_entities, the number of mentions replaced.

    E-mail addresses, IPv4 addresses, telephone, card, account and social security numbers, and names: after a
    title, or a known given name and what capitalised words follow. Other names are not found. The key is secret:
    who has it can look for the numbers behind the surrogates. Whole texts are read, once. A text without an entity,
    an empty or null one included, stays as it is with n_entities 0. Rows that repeat an id are replaced each by
    its own text; the same entity gets the same surrogate everywhere. Other columns pass through, whatever
    their names; an n_entities column is replaced. An empty table gives an empty result.
    """
    if not key:
        raise ValueError("surrogates need a key")
    # the cheap signs first: most texts have none, and every text that holds an entity has one
    sign = F.col(text).contains("@") | F.col(text).rlike(SIGN)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.when(sign, F.regexp_extract_all(F.col(text), F.lit(ENTITY), 0)).alias("m"), F.monotonically_increasing_id().alias("uid"))
    marked = stored(marked, "marked", compression="zstd")
    hit = F.coalesce(F.size("m"), F.lit(0)) > 0
    mentions = marked.filter(hit).select("uid", F.posexplode("m").alias("i", "mention"))
    pieces = stored(mentions.select("uid", "i", F.posexplode(pieces_of(F.col("mention"))).alias("j", "p")).select("uid", "i", "j", "p.*", F.pmod(F.xxhash64("uid", "i"), F.lit(256)).alias("part")), "mentions")
    # an entity with very many mentions is dealt to parts
    parts = stored(pieces.select("kind", "canon", "part").distinct(), "parts")
    table = assigned(stored(parts.select("kind", "canon").distinct(), "entities"), key)
    new = pieces.join(parts.join(table, ["kind", "canon"]), ["kind", "canon", "part"]).withColumn("new", F.concat("lead", _written(F.col("own"), F.col("kind"), F.col("surrogate"), F.col("woman"))))
    joined = lambda c, at: F.transform(F.array_sort(F.collect_list(F.struct(at, c))), lambda x: x[c])
    new = new.groupBy("uid", "i").agg(F.array_join(joined("new", "j"), "").alias("new"))
    new = new.groupBy("uid").agg(joined("new", "i").alias("new"))
    rest = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (text, "n_entities")]
    found = marked.filter(hit).join(new, "uid")
    gaps = F.split(F.col("row")[text], ENTITY, -1)
    whole = F.array_join(F.zip_with(gaps, F.array_append("new", F.lit("")), lambda a, b: F.concat(a, b)), "")
    found = found.select(*rest, whole.alias(text), F.size("new").alias("n_entities"))
    return found.union(marked.filter(~hit).select(*rest, F.col("row")[text].alias(text), F.lit(0).alias("n_entities")))
