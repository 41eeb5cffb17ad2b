"""Personal data by weak supervision.

Expressions find candidate spans. Labelers (strict format, validity, gazetteer,
context, contrary context, shape) vote on each for, against or not at all;
expectation-maximisation estimates from the votes' patterns how reliable each
is for each kind of span; its posteriors are the soft labels of the final
classifier, a naive Bayes model of a span's features. DataFrame functions only:
the loop of the estimation sums over the at most 3**6 patterns of votes a kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, collected, meeting, order_key, stored

#: The base kinds in order. A run that could start earlier can't start later, so the search begins at a run's start or the last match's end.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further kinds that only the method finds.
ADDED = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[\x20.-]?)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "name": r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:[\x20-]\p{Lu}\p{Ll}+){0,2}",
    "secret": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[_-](?:live[_-]|test[_-])?[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})|(?<=(?:key|token|secret|passwor?d)[\"']?\x20?[:=]\x20?[\"']?)[A-Za-z0-9+/_-]{12,}",
}
KINDS = (*BASE, *ADDED)
#: What a text must have for a kind's expression to run.
_GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "ssn": "[0-9]-[0-9]", "tel": r"[0-9][)\x20.-]", "iban": "[A-Z]{2}[0-9]{2}", "name": r"[rseaufz]\.?\x20\p{Lu}", "secret": "AKIA|gh[pousr]_|sk[_-]|eyJ|key|token|secret|passwor?d"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Gazetteers: usual top-level domains, calling codes, IBAN countries, given and family names, issuers' first digits.
_DOMAINS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|io|co|ai|app|dev|me|tv|online|site|shop|xyz|cloud|tech|blog|example|eu|de|fr|es|it|uk|us|ca|au|nz|jp|cn|kr|tw|hk|sg|in|id|my|th|vn|ph|"
    "br|ar|mx|cl|pe|co|nl|be|lu|ch|at|dk|se|no|fi|is|ie|pt|pl|cz|sk|hu|ro|bg|gr|hr|si|rs|ua|ru|by|lt|lv|ee|tr|il|ae|sa|ir|za|ng|ke|eg|ma"
)
_CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GI|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR"
_NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Alice|Bob|Emma|Olivia|Noah|Liam|Peter|Paul|Mark|George|"
    "Hans|Karl|Klaus|Jürgen|Wolfgang|Anna|Maria|Ursula|Monika|Petra|Sabine|Jean|Pierre|Michel|André|Marie|Claire|Sophie|Camille|Jeanne|José|Juan|Antonio|Manuel|Francisco|Carmen|Ana|Isabel|Lucía|Dolores|"
    "Smith|Jones|Taylor|Brown|Williams|Wilson|Johnson|Davies|Miller|Davis|Evans|Walker|Wright|Green|Hall|Müller|Schmidt|Schneider|Fischer|Weber|Meyer|Wagner|Becker|Hoffmann|Schäfer|Meier|"
    "Martin|Bernard|Dubois|Robert|Durand|Moreau|Laurent|Simon|Lefebvre|Leroy|García|González|Rodríguez|Fernández|López|Martínez|Sánchez|Pérez|Gómez|Ruiz"
)
#: Words that stand before a kind, and before other numbers.
_CUES = {
    "email": "mail|contact|write|reach|kontakt|courriel|correo", "ip": "ip|host|server|address|login|from", "card": "card|visa|credit|payment|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "ssn": "ssn|social|security", "tel": "phone|tel|call|mobile|fax|telefon", "iban": "iban|account|konto|compte|cuenta|bank", "name": "name|dear|contact|by|from|signed", "secret": "key|token|secret|password|bearer|credential",
}
_CONTRARY = "version|release|build|isbn|doi|order|invoice|serial|page|pages|price|total|section|chapter|figure"
#: Slots of hashed features of a span.
SLOTS = 1024
_ROUNDS = 12
_LEAN = 2.0
#: A kind's estimates lean on those of all kinds together, as if so many of its spans had voted like them.
_POOLED = 10.0
_LABELERS = 6


def _spans(text: Column, expression: str, gate: str) -> Column:
    """s, e (code points, end excluded) and m of the leftmost matches that don't overlap."""
    kind = "struct<s:int,e:int,m:string>"
    both = F.arrays_zip(F.split(text, expression, -1).alias("before"), F.regexp_extract_all(text, F.lit(expression), F.lit(0)).alias("m"))
    start = lambda n, x: n + F.length(x["before"])
    end = lambda n, x: start(n, x) + F.coalesce(F.length(x["m"]), F.lit(0))
    found = collected(both, F.lit(0), kind, lambda n, x: F.struct(start(n, x).alias("s"), end(n, x).alias("e"), x["m"].alias("m")), end)
    return F.when(text.rlike(gate), F.filter(found, lambda x: x["m"].isNotNull())).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


_CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(13, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, m: Column, before: Column, after: Column) -> Column:
    """The labelers' votes on a span of a kind: 1 for, -1 against, 0 none."""
    digits = _digits(m)
    never = F.lit(False)
    strict = {"email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@.*\.[A-Za-z]{2,24}$", "ip": r"^(?:[1-9][0-9]{0,2}\.)(?:(?:0|[1-9][0-9]{0,2})\.){2}(?:0|[1-9][0-9]{0,2})$", "card": r"^[0-9]{4}([ -]?)[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{1,7})?$", "phone": r"^\+[1-9]", "ssn": "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", "tel": r"^\(?[2-9]", "iban": "^[A-Z]{2}[0-9]{2}", "name": r"^\S+ \p{Lu}\p{Ll}{2,}", "secret": "[0-9]"}[kind]
    valid = {"ip": (~m.rlike(r"^(?:0|255)\."), m.rlike(r"^(?:0|255)\.")), "card": (~m.rlike("^0"), m.rlike("^0")), "phone": (F.length(digits).between(10, 13), never), "tel": (F.length(digits) == 10, never)}.get(kind, (never, never))
    gazetteer = {"email": rf"(?i)\.(?:{_DOMAINS})$", "ip": r"^(?:10|127|172|192)\.", "card": "^[3-6]", "phone": rf"^\+(?:{_CALLING})", "iban": f"^(?:{_COUNTRIES})", "name": f"(?:{_NAMES})"}.get(kind)
    shape = {"email": (6, 64), "ip": (7, 15), "card": (13, 23), "phone": (10, 20), "ssn": (11, 11), "tel": (12, 14), "iban": (15, 42), "name": (5, 40), "secret": (12, 400)}[kind]
    inside = F.length(m).between(*shape)
    return F.array(
        _vote(m.rlike(strict), ~m.rlike(strict)),
        _vote(*valid),
        _vote(m.rlike(gazetteer), never) if gazetteer else F.lit(0),
        _vote(before.rlike(rf"\b(?:{_CUES[kind]})\b"), never),
        _vote(never, before.rlike(rf"\b(?:{_CONTRARY})\b[^\p{{L}}]*$") | after.rlike("^[0-9A-Za-z_]")),
        _vote(inside, ~inside),
    )


def _features(kind: str, m: Column, before: Column, after: Column) -> Column:
    """Slots of the features: the kind with what stands next to the span, its length, and the words before."""
    kinds = lambda c: F.when(c == "", "e").when(c.rlike(r"^\s"), "s").when(c.rlike(r"^\p{L}"), "l").when(c.rlike("^[0-9]"), "d").otherwise("o")
    words = F.split(before, r"[^\p{L}]+")
    values = (F.lit(kind), kinds(F.right(before, F.lit(1))), kinds(after), F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("string"), F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2)))
    return F.array(*[F.pmod(F.xxhash64(F.lit(f"{kind}/{i}"), F.coalesce(v, F.lit(""))), F.lit(SLOTS)).cast("int") for i, v in enumerate(values)])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> o, and for each kind an array of spans (s, e, votes, features); base kinds' have passed their check, others
    don't overlap them."""
    rows = docs.select(order_key(id_col).alias("o"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = {k: _spans(F.col("text"), x, _GATES[k]) for k, x in (BASE | ADDED).items()}
    passed = lambda k: F.filter(spans[k], lambda y: _CHECKS[k](y["m"]))
    rows = rows.select("o", "text", *[passed(k).alias(k) for k in BASE]).withColumn("base", F.array(*BASE))
    new = lambda k: F.filter(spans[k], lambda y: ~F.exists("base", lambda b: F.size(meeting(b, y)) > 0))
    rows = rows.select("*", *[new(k).alias(k) for k in ADDED])

    def judged(kind: str) -> Column:
        def one(x):
            before = F.lower(F.substring(F.col("text"), F.greatest(x["s"] - 39, F.lit(1)), F.least(x["s"], F.lit(40))))
            after = F.substring(F.col("text"), x["e"] + 1, F.lit(1))
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _votes(kind, x["m"], before, after).alias("votes"), _features(kind, x["m"], before, after).alias("features"))

        return F.transform(kind, one)

    return rows.select("o", *[judged(k).alias(k) for k in KINDS])


def reliabilities(votes: DataFrame) -> dict[str, list[float]]:
    """votes (kind, votes, an array) of all candidates -> for each kind the share of true spans, then for either class each labeler's chances of a vote for and of one against.

    Dawid and Skene's estimate, begun from the majority. Each round sums over
    the patterns of votes of each kind, whose number doesn't grow with the
    corpus.
    """
    patterns = stored(votes.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n")), "votes")
    posterior = 1 / (1 + F.exp(-F.aggregate("votes", F.lit(0.0), lambda a, v: a + v)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    weights = (F.col("n") * F.col("q"), F.col("n") * (1 - F.col("q")))
    voted = [total(F.when(F.col("votes")[j] == v, w)) for w in weights for j in range(_LABELERS) for v in (1, -1)]
    half = 2 * _LABELERS
    model: dict[str, list[float]] = {}
    for _ in range(_ROUNDS):
        rows = patterns.select("kind", "votes", "n", posterior.alias("q")).groupBy("kind").agg(*[total(w) for w in weights], *voted).collect()  # a row a kind
        if not rows:
            break
        sums = {r[0]: list(r)[1:] for r in rows}
        whole = [sum(x) for x in zip(*sums.values(), strict=True)]
        # before anything is seen, two of four votes are right, one is wrong and one is none
        pooled = [(x + (2 if (i < half) == (i % 2 == 0) else 1)) / (whole[i // half] + 4) for i, x in enumerate(whole[2:])]
        share = (whole[0] + 1) / (whole[0] + whole[1] + 2)
        for kind, own in sums.items():
            chances = [(x + _POOLED * p) / (own[i // half] + _POOLED) for i, (x, p) in enumerate(zip(own[2:], pooled, strict=True))]
            model[kind] = [(own[0] + _POOLED * share) / (own[0] + own[1] + _POOLED), *chances]
        posterior = posterior_of(model, "kind", "votes")
    return model


def posterior_of(model: dict[str, list[float]], kind: str, votes: str) -> Column:
    """The chance that a span of this kind with these votes is true; model as reliabilities gives it."""
    if not model:
        return F.lit(0.5)
    table = F.element_at(F.create_map(*[x for k, m in sorted(model.items()) for x in (F.lit(k), F.array(*[F.lit(v) for v in m]))]), F.col(kind))

    def likelihood(prior, first):
        chance = lambda j, v: F.element_at(table, F.lit(first + 2 * j + v + 1))
        of = lambda j: F.when(F.col(votes)[j] > 0, chance(j, 0)).when(F.col(votes)[j] < 0, chance(j, 1)).otherwise(1 - chance(j, 0) - chance(j, 1))
        return reduce(lambda a, j: a * of(j), range(_LABELERS), prior)

    a, b = likelihood(F.element_at(table, F.lit(1)), 1), likelihood(1 - F.element_at(table, F.lit(1)), 1 + 2 * _LABELERS)
    return a / (a + b)


def classifier(labelled: DataFrame) -> DataFrame:
    """labelled (features, q) -> one row: `weights`, the prior's log-odds and those of each slot."""
    whole = labelled.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("a"), F.coalesce(F.sum(1 - F.col("q")), F.lit(0.0)).alias("b"))
    slots = labelled.select("q", F.explode("features").alias("slot")).groupBy("slot").agg(F.sum("q").alias("a"), F.sum(1 - F.col("q")).alias("b"))
    one = labelled.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left").fillna(0.0)
    total = whole.select(F.struct("a", "b").alias("t"))
    share = (F.col("a") + F.col("b")) / (F.col("t.a") + F.col("t.b"))  # either class leans on it, as if it had been seen _LEAN times
    chance = lambda c: F.log((F.col(c) + _LEAN * share) / (F.col(f"t.{c}") + _LEAN))
    weight = F.when(F.col("a") + F.col("b") > 0, chance("a") - chance("b")).otherwise(0.0)
    one = one.withColumn("t", total.scalar()).select("slot", weight.alias("w"), F.log((F.col("t.a") + 1) / (F.col("t.b") + 1)).alias("prior"))
    return one.agg(F.concat(F.array(F.first("prior")), F.transform(F.array_sort(F.collect_list(F.struct("slot", "w"))), lambda x: x["w"])).alias("weights"))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, and for each kind an array of spans (s, e in code points, end excluded), for each row.

    Spans of the base kinds are all that their expression and check give; those
    of added kinds are the candidates that the classifier takes for true, less
    those that overlap another one of larger odds (of equal odds: a longer one,
    one of an earlier kind). Null and empty texts have none. Without candidates
    nothing is trained and nothing added. Repeated rows each get their row and
    count in training; other columns have no part; no rows give none.
    """
    rows = stored(candidates(docs, id_col, text_col), "candidates")
    every = rows.select(F.explode(F.concat(*KINDS)).alias("x")).select("x.kind", "x.votes", "x.features")
    trusted = reliabilities(every)
    model = stored(classifier(every.withColumn("q", posterior_of(trusted, "kind", "votes"))), "pii-classifier")
    rows = rows.withColumn("weights", model.scalar())
    odds = lambda x: F.aggregate(x["features"], F.element_at(F.col("weights"), 1), lambda a, f: a + F.element_at(F.col("weights"), f + 2))
    rated = lambda k, i: F.transform(k, lambda x: F.struct(F.struct(odds(x).alias("odds"), (x["e"] - x["s"]).alias("length"), F.lit(-i).alias("kind")).alias("rank"), x["s"].alias("s"), x["e"].alias("e")))
    likely = F.array(*[F.filter(rated(k, i), lambda x: x["rank"]["odds"] > 0) for i, k in enumerate(ADDED)])
    # spans of one kind are in order and don't overlap, so those of two kinds that meet are no more than both together
    best = lambda x: ~F.exists("likely", lambda a: F.exists(meeting(a, x), lambda y: y["rank"] > x["rank"]))
    rows = rows.withColumn("likely", likely).withColumn("apart", F.transform("likely", lambda own: F.filter(own, best)))
    thin = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    chosen = {k: F.col(k) for k in BASE} | {k: F.col("apart")[i] for i, k in enumerate(ADDED)}
    return rows.select(F.when(F.col("o") != LOWEST, F.col("o")).alias("doc_id"), *[thin(chosen[k]).alias(k) for k in KINDS])


def digest(spans: DataFrame) -> DataFrame:
    """found's rows -> doc_id, n_<base kind>, base_sha256, spans."""
    named = lambda k: F.transform(k, lambda x: F.concat_ws(":", F.lit(k), x["s"], x["e"]))
    listed = lambda kinds: F.array_join(F.concat(*[named(k) for k in kinds]), ",")
    return spans.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(listed(BASE), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
