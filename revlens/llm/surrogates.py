"""Personal data replaced by keyed surrogates, in DataFrame and SQL functions only.

Entities: e-mail addresses, IPv4 addresses, phone numbers, payment cards and
long account numbers (13 to 19 digits), social security numbers, IBANs, and
person names led by a title or a known given name. One regular expression cuts
a text into entities and gaps. In a text with names, each other word that
starts with a capital is looked up among the names of its own text, whatever
its case: a bare ``Smith`` or ``SMITH'S`` beside ``Mr. John Smith`` is a
further mention. A word that starts with a small letter is none.

An entity's canonical form (lower-case address, bare digits, lower-case name)
decides its surrogate, so mentions in other formats corefer. A surrogate is
drawn from SHA-256 of key, kind, canonical form and attempt. The key is a
parameter, or the setting ``KEY_SETTING``; where neither is given, the public
``KEY`` serves, which hides nothing from who knows it. A surrogate keeps kind and
format: letters stay letters of the same script and case, digits digits,
punctuation, country codes, top-level domains, card networks and Luhn validity
stay, IPv4 numbers stay valid, given names keep gender and script. All
distinct entities of the table are checked: a surrogate that another entity
has, or that occurs in the data, is drawn again with the next attempt, so
distinct entities stay distinct and no surrogate is a real entity. From attempt
``LONGER`` on, addresses gain letters and numbers digits, one more an attempt,
so a format with few values does not run out.

Scale: documents without entities pass through unchanged and unshuffled. The
others are written once to the shared checkpoint folder; the distinct
entities and their surrogates join them by entity (a hot entity is an
adaptive skew join) and texts are put together again by row.

Defined cases: null text stays null, empty stays empty; null ids are kept;
repeated rows get the same surrogates; no entity at all: the texts as they
are. IBAN check digits are not recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.frames import small_batches, stored

#: the session's setting that holds the secret key, and what stands in for it in tests
KEY_SETTING = "spark.revlens.surrogates.key"
KEY = "corpus-surrogates"
#: the first attempt that lengthens e-mail addresses and numbers
LONGER = 8

#: titles (fixed values) by the gender they tell
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor"), "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora"), "n": ("Dr", "Prof", "Professor")}
#: given names that are known and drawn from (fixed values), by script and gender
GIVEN = {
    ("latin", "m"): ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Peter", "Paul", "Hans", "Pierre", "Carlos"),
    ("latin", "f"): ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Laura", "Emma", "Marie", "Claire", "Carmen"),
    ("cyrillic", "m"): ("Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Николай", "Михаил", "Павел"),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"),
}
#: syllables of drawn surnames (fixed values)
SYLLABLES = {"latin": ("bar", "den", "fol", "gan", "hal", "jor", "kel", "lin", "mor", "nes", "pol", "ran", "sel", "tor", "ven", "wes"),
             "cyrillic": ("бар", "вен", "гор", "дан", "зел", "кар", "лен", "мор", "ник", "пол", "рад", "сел", "тор", "фед", "хар", "шев")}
HAN = "一丁七万三上下不与世中主久之乐九书事二五京人今代伊会伯伴位住作"
CYRILLIC, GREEK = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"

# every repeat is bounded (an address by the limits of mail and host names, at most 30 labels): the
# matcher recurses once a repeated group, and a text may hold a run of any length
_WORD = r"\p{Lu}[\p{L}\p{M}'’-]{1,60}"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_KNOWN = "|".join(n for g in GIVEN.values() for n in g)
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,30}\p{L}{2,63}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ssn": r"(?<!\d)(?<!\d-)\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "card": r"(?<!\d)(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
    "phone": r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d(])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? {_WORD}(?: {_WORD}){{0,2}}|(?:{_KNOWN}) {_WORD})(?![\p{{L}}\p{{N}}])",
}
# what a kind can start with is tested first, so most places fail on one character
_NUMBERS = "(?=[0-9+(])(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "ssn", "card", "phone")) + ")"
_IBANS = f"(?=[A-Z][A-Z][0-9])(?:{PATTERNS['iban']})"
_NAMES = f"(?=[A-ZА-Я])(?:{PATTERNS['name']})"
ANY = f"(?:{PATTERNS['email']})|{_IBANS}|{_NUMBERS}|{_NAMES}"
# a capitalised word, joined ones whole (O'Brien), unless a name or an address starts inside it
_BARE = (rf"(?<![\p{{L}}\p{{M}}\p{{N}}])\p{{Lu}}[\p{{L}}\p{{M}}]{{0,60}}(?:['’-](?!(?:{_TITLE}|{_KNOWN})(?![\p{{L}}\p{{M}}]))\p{{Lu}}[\p{{L}}\p{{M}}]{{0,60}}){{0,3}}"
         r"(?![\p{L}\p{M}\p{N}])(?![\p{L}\p{M}\p{N}._%+-]{0,64}+@)")
ANY_OR_BARE = f"{ANY}|{_BARE}"
#: what may end a name without being part of it
_TAIL = "(?:['’][sS]|['’-]+)$"
DIGIT_KINDS = ("phone", "card", "ssn", "iban")


def kind_of(entity: Column) -> Column:
    out = F.when(entity.contains("@"), "email")
    for kind in ("iban", "ip", "ssn", "card"):
        out = out.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    letter_first = entity.rlike(r"^\p{L}")  # names have a space, after their title or given name
    return out.when(letter_first & entity.contains(" "), "name").when(letter_first, "word").otherwise("phone")


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def chars(text: Column) -> Column:
    return F.split(text, "")


def stream(seed: Column, n: Column) -> Column:
    """At least two hex digits for each of ``n`` places."""
    return F.array_join(F.transform(F.sequence(F.lit(0), (n / 32).cast("int")), lambda b: F.sha2(F.concat(seed, F.lit("|"), b.cast("string")), 256)), "")


def number(digest: Column, place: Column, wide: int = 2) -> Column:
    return F.conv(F.substr(digest, place * 2 + 1, F.lit(wide)), 16, 10).cast("int")


def letter(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def draw_char(c: Column, n: Column) -> Column:
    """A character of the same class and script; others stay. Canonical letters are lower case."""
    return (F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.rlike("[A-Z]"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .when(c.rlike(r"\p{IsCyrillic}"), letter(CYRILLIC, n)).when(c.rlike(r"\p{IsGreek}"), letter(GREEK, n))
            .when(c.rlike(r"\p{IsHan}"), letter(HAN, n))
            .when(c.rlike(r"\p{L}"), letter("abcdefghijklmnopqrstuvwxyz", n)).otherwise(c))


def luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, modulo 10."""
    def add(acc, c):
        v = c.cast("int") * (F.lit(1) + F.pmod(acc["k"], F.lit(2)))
        return F.struct((acc["s"] + v - F.when(v > 9, 9).otherwise(0)).alias("s"), (acc["k"] + 1).alias("k"))
    return F.pmod(F.aggregate(chars(F.reverse(digits)), F.struct(F.lit(0).alias("s"), F.lit(0).alias("k")), add)["s"], F.lit(10))


def candidate(kind: Column, canon: Column, gender: Column, key: str, attempt: int) -> Column:
    """The surrogate canonical form that an attempt draws."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, F.lit(str(attempt)))
    digest = stream(seed, F.char_length(canon))

    def drawn(low: Column, high: Column) -> Column:
        """The characters from ``low`` up to ``high`` drawn, the others kept."""
        return F.array_join(F.transform(chars(canon), lambda c, i: F.when((i >= low) & (i < high), draw_char(c, number(digest, i))).otherwise(c)), "")

    size = F.char_length(canon)
    more = F.sha2(F.concat(seed, F.lit("|longer")), 256)
    extra = range(min(24, max(0, attempt - LONGER + 1)))
    letters = F.concat(F.lit(""), *[letter("abcdefghijklmnopqrstuvwxyz", number(more, F.lit(i))) for i in extra])
    digits = F.concat(F.lit(""), *[F.pmod(number(more, F.lit(i)), F.lit(10)).cast("string") for i in extra])
    email = F.concat(letters, drawn(F.lit(0), size - F.char_length(F.substring_index(canon, ".", -1))))
    octet = lambda o, i: (F.when(F.lit(attempt >= 4), F.pmod(number(digest, i, 4), F.lit(223)) + 1)
                          .when(F.length(o) == 1, F.pmod(number(digest, i, 4), F.lit(9)) + 1).when(F.length(o) == 2, F.pmod(number(digest, i, 4), F.lit(90)) + 10)
                          .otherwise(F.pmod(number(digest, i, 4), F.lit(124)) + 100)).cast("string")
    ip = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
    plain = drawn(F.when(kind == "phone", F.greatest(size - 10, F.lit(0))).when(kind == "iban", 2).when(kind == "card", 1).otherwise(0), size)
    plain = F.concat(plain, digits)
    body = F.substr(plain, F.lit(1), F.char_length(plain) - 1)
    check = F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(luhn(canon) == 0, F.concat(body, check)).otherwise(plain)
    script = script_of(canon)
    pick = F.pmod(F.conv(F.substr(digest, F.lit(1), F.lit(6)), 16, 10).cast("int"), F.lit(1 << 20))
    given = F.lit(None).cast("string")
    for (s, g), names in GIVEN.items():
        given = F.when((script == s) & (gender == g), F.element_at(F.array(*map(F.lit, names)), (F.pmod(pick, F.lit(len(names))) + 1).cast("int"))).otherwise(given)
    tail = lambda n: F.when(script == "cyrillic", syllables("cyrillic", digest, n)).otherwise(syllables("latin", digest, n))
    given = F.lower(F.concat(given, tail(attempt - 3)) if attempt > 3 else given)
    surname = F.concat(tail(3 + attempt // 2), F.when((script == "cyrillic") & (gender == "f"), "ова").when(script == "cyrillic", "ов").otherwise(""))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "given", given).when(kind == "surname", surname).otherwise(plain))


def syllables(script: str, digest: Column, n: int) -> Column:
    parts = F.array(*map(F.lit, SYLLABLES[script]))
    return F.concat(*[F.element_at(parts, (F.pmod(number(digest, F.lit(4 + i)), F.lit(len(SYLLABLES[script]))) + 1).cast("int")) for i in range(max(1, n))])


def draw(entities: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """(kind, canon, gender, surrogate) of the distinct (kind, canon, gender), all surrogates of a kind distinct.

    Each round keeps a candidate that no earlier round and no other entity of
    its round has and that is no entity itself; the rest draw again.
    """
    entities = stored(entities)
    real = entities.select("kind", F.col("canon").alias("surrogate")).distinct()
    done: DataFrame | None = None
    left = entities
    for attempt in range(rounds):
        drawn = left.withColumn("surrogate", candidate(F.col("kind"), F.col("canon"), F.col("gender"), key, attempt))
        taken = real if done is None else real.union(done.select("kind", "surrogate"))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min(F.struct("canon", "gender")).alias("w"))
        won = first.select("kind", "w.canon", "w.gender", "surrogate")
        done = stored(won if done is None else done.union(won))
        left = stored(left.join(done, ["kind", "canon", "gender"], "left_anti"))
        if left.isEmpty():
            return done
    raise ValueError("no free surrogate: an entity format leaves too few values")


def canonical(kind: Column, entity: Column) -> Column:
    return F.when(kind.isin(*DIGIT_KINDS), F.upper(F.regexp_replace(entity, "[^A-Za-z0-9]", ""))).otherwise(F.lower(entity))


def render(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate in the format of a mention."""
    def place(acc, c):
        token = c.rlike("[A-Za-z0-9]")
        return F.struct(F.concat(acc["out"], F.when(token, F.substr(surrogate, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("out"),
                        (acc["k"] + token.cast("int")).alias("k"))
    placed = F.aggregate(chars(entity), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), place)
    digits = F.concat(placed["out"], F.substr(surrogate, placed["k"] + 1, F.char_length(surrogate)))  # a longer one's rest
    cased = F.array_join(F.zip_with(chars(entity), chars(surrogate), lambda a, b: F.when(a.rlike(r"\p{Lu}"), F.upper(b)).otherwise(b)), "")
    return F.when(kind.isin(*DIGIT_KINDS), digits).when((kind == "email") & (F.char_length(entity) == F.char_length(surrogate)), cased).otherwise(surrogate)


def name_parts(entity: Column) -> Column:
    """Tokens of a name mention: struct(role, token, gender); roles title, given, surname."""
    words = F.split(entity, " ")
    first = F.regexp_replace(words[0], r"\.$", "")
    titled = first.isin(*[t for g in TITLES.values() for t in g])
    gender = F.when(first.isin(*TITLES["m"]), "m").when(first.isin(*TITLES["f"]), "f")
    known = F.array_join(F.filter(words, lambda w: w.isin(*[n for g in GIVEN.values() for n in g])), " ")
    by_name = F.when(F.substring_index(known, " ", 1).isin(*[n for (_, g), ns in GIVEN.items() if g == "f" for n in ns]), "f").otherwise("m")
    gender = F.coalesce(gender, by_name)
    return F.transform(words, lambda w, i: F.struct(
        F.when((i == 0) & titled, "title").when(i == F.size(words) - 1, "surname").otherwise("given").alias("role"), w.alias("token"), gender.alias("gender")))


def name_canon(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, _TAIL, ""))


def render_name(token: Column, surrogate: Column) -> Column:
    """A drawn name in the case of a mention, with its ending (Smith's)."""
    base = F.regexp_replace(token, _TAIL, "")
    cased = F.when((F.char_length(base) > 1) & (F.upper(base) == base), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.concat(cased, F.substr(token, F.char_length(base) + 1, F.char_length(token)))


def mentions(found: DataFrame) -> DataFrame:
    """(row, at, part, kind, canon, gender, entity) of every piece of ``found`` (row, entities); titles and
    words that are no name of their row keep their text."""
    one = found.select("row", F.posexplode("entities").alias("at", "entity")).withColumn("kind", kind_of(F.col("entity")))
    plain = one.where(~F.col("kind").isin("name", "word")).select(
        "row", "at", F.lit(0).alias("part"), "kind", canonical(F.col("kind"), F.col("entity")).alias("canon"), F.lit("").alias("gender"), "entity")
    parts = one.where("kind = 'name'").select("row", "at", F.posexplode(name_parts(F.col("entity"))).alias("part", "p"))
    # a surname has one surrogate whoever bears it, apart from gendered Cyrillic forms
    gender = F.when(F.col("p.role") == "given", F.col("p.gender")).when(script_of(F.col("p.token")) == "cyrillic", F.col("p.gender")).otherwise("")
    names = parts.select("row", "at", "part", F.col("p.role").alias("kind"), name_canon(F.col("p.token")).alias("canon"), gender.alias("gender"), F.col("p.token").alias("entity"))
    # a word that is both a given name and a surname of its text counts as the surname
    told = names.where("kind != 'title'").groupBy("row", "canon").agg(F.max(F.struct("kind", "gender")).alias("name"))
    words = one.where("kind = 'word'").select("row", "at", name_canon(F.col("entity")).alias("canon"), "entity").join(told, ["row", "canon"], "left")
    bare = words.select("row", "at", F.lit(0).alias("part"), F.coalesce("name.kind", F.lit("word")).alias("kind"), "canon",
                        F.coalesce("name.gender", F.lit("")).alias("gender"), "entity")
    return plain.union(names).union(bare)


def replace(docs: DataFrame, key: str | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``count`` names a column for the number of entities, further mentions of names included."""
    small_batches(docs.sparkSession)
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text").cast("string").alias("t"))
    t = F.col("t")
    some = t.isNotNull() & ((t.contains("@") & t.rlike(PATTERNS["email"])) | (t.rlike("[0-9]") & (t.rlike(_NUMBERS) | t.rlike(_IBANS))) | t.rlike(_NAMES))
    extra = [F.lit(0).cast("long").alias(count)] if count else []
    clean = held.where(~F.coalesce(some, F.lit(False))).select(*[F.col(f"_row.`{c}`").alias(c) for c in names], *extra)
    first = held.where(some).select("_row", "t", F.regexp_extract_all("t", F.lit(ANY), F.lit(0)).alias("first"))
    named = first.withColumn("named", F.exists("first", lambda e: kind_of(e) == "name"))
    found = stored(named.select("_row", F.when(F.col("named"), F.regexp_extract_all("t", F.lit(ANY_OR_BARE), F.lit(0))).otherwise(F.col("first")).alias("entities"),
                                F.when(F.col("named"), F.split("t", ANY_OR_BARE, -1)).otherwise(F.split("t", ANY, -1)).alias("gaps"))
                   .withColumn("row", F.monotonically_increasing_id()))
    pieces = mentions(found)
    surrogate = draw(pieces.where("kind not in ('title', 'word')").select("kind", "canon", "gender").distinct(), key)
    new = pieces.join(surrogate, ["kind", "canon", "gender"], "left").select(
        "row", "at", "part", "kind", F.coalesce(F.when(F.col("kind").isin("given", "surname"), render_name(F.col("entity"), F.col("surrogate")))
                                                .otherwise(render(F.col("kind"), F.col("entity"), F.col("surrogate"))), F.col("entity")).alias("new"))
    joined = new.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "part", "new"))).alias("news"),
                                    F.count_if((F.col("part") == 0) & (F.col("kind") != "word")).alias("n"))
    whole = found.join(joined, "row")
    # pieces of one name are joined by spaces; then gap 0, entity 0, gap 1, ...
    before = lambda x: F.when(x["part"] > 0, " ").otherwise(F.element_at(F.col("gaps"), x["at"] + 1))
    text = F.concat(F.array_join(F.transform("news", lambda x: F.concat(before(x), x["new"])), ""), F.element_at("gaps", -1))
    cols = [(text if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in names]
    return whole.select(*cols, *([F.col("n").alias(count)] if count else [])).union(clean)


def report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """Per document: doc_id, text with surrogates, n_entities."""
    return replace(docs.select("doc_id", "text"), key, "n_entities")
