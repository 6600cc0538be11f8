"""Personal data by weak supervision.

Exact patterns give the base spans: addresses of mail and machines, cards and phone numbers.  Wider patterns give
candidates: names, and numbers in groups.  Further candidates lie in matches that an exact pattern found and a rule
dropped, as a run of digits that holds two cards, or a phone number that went on into an address: whole groups of such a
match, clear of the base spans.  Labelers vote on each candidate by its shape, by gazetteers, by the words around it, by
its length and by how it ends.  Expectation maximisation estimates how reliable each labeler is from how they agree, and
a logistic span classifier is fitted to the estimated labels; candidates that it is sure of become spans too.

All rows are handled by SQL expressions.  Only counts of vote patterns reach the driver, and there are at most three to
the power of the labelers of them for each kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from typeloom.llm.common import digest, stored, text_of
from typeloom.llm.registry import load, query

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "number", "name", "card_in_run", "phone_in_run")
LABELERS = ("shape", "gazetteer", "context", "length", "ending")
#: Digits of a card and of a phone number, and the kinds of candidates sought in matches of these that were dropped.
DIGITS = {"card": (14, 19), "phone": (10, 15)}
IN_RUN = {"card": "card_in_run", "phone": "phone_in_run"}
#: Chance from which a candidate becomes a span.
SURE = 0.9

_MAIL = "A-Za-z0-9._%+-"
_TITLE = "(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)"
#: Possessive repetition neither recurses nor backtracks, so long runs cost linear time.  A run is tried from its start
#: only, or from where the match before it ended.  A pattern that begins with a choice first looks at one character.
PATTERNS = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "number": r"(?=[(0-9])(?<![0-9.+-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,5}){1,4}(?![0-9])",
    "name": rf"(?=\p{{Lu}})(?:{_TITLE}\.? \p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?+|(?<!\p{{L}})\p{{Lu}}\p{{Ll}}++ \p{{Lu}}\p{{Ll}}++)",
}
#: What a text must hold for a pattern to be tried on it.
_NEEDS = {"email": "@", "phone": "+", "ip": "."}

_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
_GIVEN = "anna|carlos|claire|david|elena|emma|hans|james|jean|john|juan|julia|karl|laura|luis|maria|marie|mary|michael|paul|peter|pierre|robert|sarah|sophie|thomas"
_STARTERS = "the|a|an|this|that|der|die|das|ein|eine|le|la|les|un|une|el|los|las|de|in|of|to|and"
_PREFIXES = "030|040|069|089|0[1-6]|9[13]|20[1-9]|21[0-9]|31[0-9]|41[0-9]|51[0-9]|61[0-9]|71[0-9]|555|800"
_NUMBER_CUES = "phone|telephone|tel|call|fax|mobile|ssn|passport|account|telefon|handy|konto|téléphone|portable|compte|teléfono|móvil|cuenta"
_CARD_CUES = "card|cards|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta"
#: First digits of card issuers, and country codes.
_ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|3[068]"
_COUNTRIES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-3689]|2[2-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9]"
_NAME_CUES = "name is|named|signed|contact|dear|regards|heiße|appelle|llamo|nombre"


def _matches(kind: str) -> Column:
    """All matches of a kind's pattern: place among them, characters before each since the last, and what is around."""
    text, pattern = F.col("text"), F.lit(PATTERNS[kind])
    context = kind not in ("email", "ip")

    def spans(found: Column, between: Column) -> Column:
        return F.transform(
            F.arrays_zip(found.alias("match"), F.slice(between, 1, F.size(found)).alias("before"),
                         F.slice(between, 2, F.size(found)).alias("after")),
            lambda x, n: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                n.alias("n"),
                F.char_length(x["before"]).alias("gap"),
                F.char_length(x["match"]).alias("size"),
                x["match"].alias("match"),
                (F.right(x["before"], F.lit(40)) if context else F.lit("")).alias("before"),
                (F.left(x["after"], F.lit(10)) if context else F.lit("")).alias("after"),
            ),
        )

    def cut(found: Column) -> Column:
        between = F.split(text, PATTERNS[kind], -1)
        return F.when(F.size(found) > 0, _once(between, lambda between: spans(found, between)))

    needed = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
    if kind in ("ip", "card", "phone", "number"):
        needed = needed & text.rlike("[0-9]")
    made = F.when(needed, _once(F.regexp_extract_all(text, pattern, F.lit(0)), cut))
    return F.coalesce(made, F.array().cast(_MATCH))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_MATCH = "array<struct<kind:int,n:int,gap:int,size:int,match:string,before:string,after:string>>"


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: every second from the right doubled, with its own digits added up."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, n: F.when(
            n % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int"))),
        F.lit(0),
        lambda s, d: s + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def _n_digits() -> Column:
    return F.char_length(F.regexp_replace("match", "[^0-9]", ""))


def _valid() -> Column:
    """Whether a base match holds up; candidates all do."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    kind = F.col("kind")
    return (
        F.when(kind == 1, F.col("match").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == 2, F.when(F.char_length(digits).between(*DIGITS["card"]), _luhn(digits)).otherwise(False))
        .when(kind == 3, F.char_length(digits).between(*DIGITS["phone"]))
        .otherwise(True)
    )


def _groups() -> Column:
    """The groups of digits of a dropped match: characters before each, its size, and both cut where too long to matter."""
    groups = F.regexp_extract_all("match", F.lit("[0-9]+"), F.lit(0))
    # A phone number starts where its match does.
    groups = F.when(F.col("kind") == KINDS.index("phone"), F.slice(groups, 1, DIGITS["phone"][1] + 1)).otherwise(groups)
    gaps = F.slice(F.split("match", "[0-9]+", -1), 1, F.size(groups))
    return F.transform(
        F.arrays_zip(groups.alias("digits"), gaps.alias("gap")),
        lambda x, g: F.struct(
            g.alias("g"),
            F.char_length(x["gap"]).alias("gap"),
            F.char_length(x["digits"]).alias("size"),
            F.left(x["gap"], F.lit(4)).alias("sep"),
            F.left(x["digits"], F.lit(DIGITS["card"][1] + 1)).alias("digits"),
        ),
    )


def _parts(dropped: DataFrame) -> DataFrame:
    """Candidates in dropped matches: groups in a row with as many digits as a card or phone number has.

    A group has one digit at least, so a window of as many groups as digits is wide enough, and work stays linear.
    """
    most = DIGITS["card"][1]
    run = W.partitionBy("id", "kind", "n").orderBy("g")
    rows = dropped.select("id", "kind", "n", "start", "end", "before", F.inline(_groups()))
    rows = rows.withColumn("to", F.col("start") + F.sum(F.col("gap").cast("long") + F.col("size")).over(run.rowsBetween(W.unboundedPreceding, W.currentRow)))
    own = F.struct("sep", "digits", "size", "to")
    rows = rows.withColumn("ahead", F.collect_list(own).over(run.rowsBetween(W.currentRow, most)))
    phone = F.col("kind") == KINDS.index("phone")
    rows = rows.withColumn("from", F.col("to") - F.col("size") - F.when(phone, 1).otherwise(0))
    digits = "aggregate(slice(ahead, 1, k), 0, (s, x) -> s + x.size)"
    low, high = (F.when(phone, DIGITS["phone"][n]).otherwise(DIGITS["card"][n]) for n in (0, 1))
    rows = rows.filter(~phone | (F.col("g") == 0)).withColumn("low", low).withColumn("high", high)
    fits = F.expr(f"filter(sequence(1, size(ahead)), k -> {digits} BETWEEN low AND high)")
    rows = rows.withColumn("k", F.explode(fits))
    text = F.expr("concat(ahead[0].digits, array_join(transform(slice(ahead, 2, k - 1), x -> concat(x.sep, x.digits)), ''))")
    rows = rows.select(
        "id", F.when(phone, KINDS.index("phone_in_run")).otherwise(KINDS.index("card_in_run")).alias("kind"), "n",
        F.concat(F.when(phone, "+").otherwise(""), text).alias("match"), "before",
        # What parts it from the digits after it.
        F.coalesce(F.expr("get(ahead, k).sep"), F.lit("")).alias("after"),
        F.col("from").alias("start"), F.expr("ahead[k - 1].to").alias("end"),
        F.col("start").alias("run_start"), F.col("end").alias("run_end"), "g", (F.col("g") + F.col("k")).alias("next"),
    )
    # The rules judged the whole match; digits that are no card are left out, whatever other labelers would say.
    rows = rows.filter("start > run_start OR end < run_end")
    card = F.col("kind") == KINDS.index("card_in_run")
    rows = rows.filter(~card | _luhn(F.regexp_replace("match", "[^0-9]", "")))
    # Whether the match goes on with nothing, or with another candidate, on either side.
    key = ["id", "kind", "n"]
    ends = rows.select(*key, F.col("next").alias("g")).distinct().withColumn("follows", F.lit(True))
    starts = rows.select(*key, F.col("g").alias("next")).distinct().withColumn("precedes", F.lit(True))
    rows = rows.join(ends, [*key, "g"], "left").join(starts, [*key, "next"], "left")
    left = F.coalesce("follows", F.col("start") == F.col("run_start"))
    right = F.coalesce("precedes", F.col("end") == F.col("run_end"))
    rows = rows.withColumn("sides", left.cast("int") + right.cast("int"))
    return rows.drop("run_start", "run_end", "g", "next", "follows", "precedes")


def find_spans(rows: DataFrame) -> DataFrame:
    """Every valid base match and every candidate clear of them; ``rows`` has ``id`` and ``text``, ids naming both.

    Places are sums over the matches of a text, so a text's work and memory stay linear in it.
    """
    every = F.concat(*(_matches(kind) for kind in KINDS if kind in PATTERNS))
    found = rows.select("id", F.inline(every)).repartition("id")
    # Rows that are alike have the same matches.
    found = found.dropDuplicates(["id", "kind", "n"])
    before = W.partitionBy("id", "kind").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(before)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).withColumn("valid", _valid())
    holds = F.lit(False)
    for kind in IN_RUN:
        holds = holds | ((F.col("kind") == KINDS.index(kind)) & (_n_digits() >= DIGITS[kind][0]))
    found = stored(found.filter(F.col("valid") | holds).drop("gap", "size"), "pii-matches")
    valid = found.filter("valid").withColumn("sides", F.lit(0))
    found = valid.drop("valid").unionByName(_parts(found.filter("NOT valid")))
    base = F.col("kind") < len(BASE_KINDS)
    order = W.partitionBy("id").orderBy("start", "kind")
    taken = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    coming = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    found = found.withColumn("taken", taken).withColumn("coming", coming)
    clear = F.coalesce(F.col("taken") <= F.col("start"), F.lit(True)) & F.coalesce(
        F.col("coming") >= F.col("end"), F.lit(True)
    )
    return found.filter(base | clear)


def _votes() -> dict[str, Column]:
    """The vote of each labeler on a candidate: 1 for, -1 against, 0 none."""
    match, before, after = F.col("match"), F.lower("before"), F.col("after")
    number, name, card, phone = (F.col("kind") == KINDS.index(k) for k in ("number", "name", "card_in_run", "phone_in_run"))
    digits = _n_digits()

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    shape = vote(
        match.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})$"),
        match.rlike(r"^[0-9]+\.[0-9]+$|^[0-9]{1,4}[.-][0-9]{1,2}[.-][0-9]{1,4}$|^[0-9]{2,4}-[0-9]{2,4}$"),
    )
    titled = vote(match.rlike(rf"^{_TITLE}\.? "), F.lit(False))
    area = vote(match.rlike(rf"^\(?(?:{_PREFIXES})[^0-9]"), F.lit(False))
    known = vote(match.rlike(rf"(?i)(?:^|[ ])(?:{_GIVEN})(?:$|[ ])"), match.rlike(rf"(?i)^(?:{_STARTERS}) "))
    told = vote(before.rlike(rf"\b(?:{_NUMBER_CUES})\b[^a-z]{{0,12}}$"), before.rlike(r"[$€£#]\s*$") | after.rlike(r"^\s*[%€£$]"))
    named = vote(before.rlike(rf"\b(?:{_NAME_CUES})\b[^a-z]{{0,6}}$"), before.rlike(r"(?:^|[.!?:|\n])\s*$"))
    long = vote(digits.between(9, 11), (digits < 7) | (digits > 15))
    words = vote(match.rlike(r"^\S+ \S+ \S+$"), F.char_length(match) < 6)
    no_vote = F.lit(0)
    paid = vote(before.rlike(rf"\b(?:{_CARD_CUES})\b[^a-z]*$"), before.rlike(r"[$€£#]\s*$"))
    grouped = match.rlike(r"^(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{5})$")
    issued = match.rlike(rf"^(?:{_ISSUERS})")
    dialled = match.rlike(r"^\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$|^\+[2-9][0-9]{0,2}(?:\)?[ .-]?\(?[0-9]{2,5}){2,5}$")
    dotted = match.rlike(r"(?:[0-9]{1,3}\.){2}[0-9]{1,3}$")
    country = match.rlike(rf"^\+(?:{_COUNTRIES})")
    american = match.startswith("+1")
    fitting = F.when(american, digits == 11).otherwise(digits.between(11, 13))
    by_kind = (
        (number, (shape, area, told, long, no_vote)),
        (name, (titled, known, named, words, no_vote)),
        (card, (vote(grouped, ~grouped), vote(issued, ~issued), paid, vote(digits.isin(15, 16), digits == 14), vote(F.col("sides") == 2, F.col("sides") == 0))),
        (phone, (vote(dialled & ~dotted, ~dialled | dotted), vote(country, ~country), told, vote(fitting, american & ~fitting),
                 vote(after.rlike(r"^[ (]"), after.rlike(r"^[.-]")))),
    )
    votes = {}
    for n, labeler in enumerate(LABELERS):
        votes[labeler] = no_vote
        for kind, cast in by_kind:
            votes[labeler] = F.when(kind, cast[n]).otherwise(votes[labeler])
    return votes


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], list[float]]:
    """Reliability of each labeler, and the chance that a candidate with each vote pattern is personal data.

    A vote is right with its labeler's reliability, given the truth, and independent of the others.  Eight imagined
    votes of the starting reliability keep labelers that hardly vote where they began; a reliability stays above a half,
    so that for and against cannot change places.
    """
    n_labelers = len(patterns[0][0])
    reliable, share = [0.8] * n_labelers, 0.2
    chances: list[float] = []
    for _ in range(rounds):
        chances = []
        for votes, _n in patterns:
            odds = math.log(share / (1 - share))
            odds += sum(v * math.log(r / (1 - r)) for v, r in zip(votes, reliable, strict=True))
            chances.append(1 / (1 + math.exp(-odds)))
        whole = sum(n for _, n in patterns)
        right, cast = [6.4] * n_labelers, [8.0] * n_labelers
        for (votes, n), chance in zip(patterns, chances, strict=True):
            for k, vote in enumerate(votes):
                if vote:
                    cast[k] += n
                    right[k] += n * (chance if vote > 0 else 1 - chance)
        reliable = [min(max(r / c, 0.55), 0.99) for r, c in zip(right, cast, strict=True)]
        share = min(max((sum(n * c for (_, n), c in zip(patterns, chances, strict=True)) + 1) / (whole + 5), 0.01), 0.5)
    return reliable, chances


def fit(patterns: list[tuple[tuple[int, ...], int]], chances: list[float], rounds: int = 400) -> list[float]:
    """Weights of a logistic classifier: a constant, then for and against for each labeler.

    The labels are the estimated chances; patterns weigh by the root of their count, and weights decay a little.
    """
    size = 1 + 2 * len(patterns[0][0])
    weights = [0.0] * size
    given = [[1, *(f for v in votes for f in (int(v > 0), int(v < 0)))] for votes, _ in patterns]
    mass = [math.sqrt(n) for _, n in patterns]
    whole = sum(mass) or 1.0
    for _ in range(rounds):
        slope = [0.0] * size
        for features, m, chance in zip(given, mass, chances, strict=True):
            z = sum(w * f for w, f in zip(weights, features, strict=True))
            error = (1 / (1 + math.exp(-z)) - chance) * m / whole
            for k, f in enumerate(features):
                slope[k] += error * f
        weights = [w - 2.0 * (s + 1e-3 * w) for w, s in zip(weights, slope, strict=True)]
    return weights


def train(candidates: DataFrame) -> dict[str, list[float]]:
    """A classifier for each kind of candidate, from all of them; a kind without candidates has none."""
    counted = candidates.groupBy("kind", *LABELERS).count().orderBy("kind", *LABELERS).collect()
    models = {}
    for kind in KINDS[len(BASE_KINDS) :]:
        own = [(tuple(r[name] for name in LABELERS), r["count"]) for r in counted if KINDS[r["kind"]] == kind]
        if own:
            models[kind] = fit(own, estimate(own)[1])
    return models


def chance(models: dict[str, list[float]]) -> Column:
    """The classifier's chance that a candidate is personal data; zero if no labeler is for it."""
    found = F.lit(0.0)
    for kind, weights in models.items():
        z = F.lit(weights[0])
        for k, name in enumerate(LABELERS):
            z = z + F.when(F.col(name) > 0, weights[1 + 2 * k]).when(F.col(name) < 0, weights[2 + 2 * k]).otherwise(0.0)
        found = F.when(F.col("kind") == KINDS.index(kind), 1 / (1 + F.exp(-z))).otherwise(found)
    return F.when(F.greatest(*LABELERS) > 0, found).otherwise(0.0)


def _apart(sure: DataFrame) -> DataFrame:
    """Candidates of one dropped match that do not overlap: from the left, the likeliest of those that start alike."""
    in_run = F.col("kind").isin([KINDS.index(kind) for kind in IN_RUN.values()])
    runs = sure.filter(in_run).groupBy("id", "kind", "n")
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("chance")).alias("less"), (-F.col("end")).alias("back")))).alias("all"))
    kept = F.expr(
        """aggregate(all, named_struct('kept', slice(all, 1, 0), 'to', 0L),
            (s, x) -> IF(x.start >= s.to, named_struct('kept', concat(s.kept, array(x)), 'to', -x.back), s), s -> s.kept)"""
    )
    runs = runs.select("id", "kind", F.explode(kept).alias("x"))
    runs = runs.select("id", "kind", "x.start", (-F.col("x.back")).alias("end"))
    return sure.filter(~in_run).select("id", "kind", "start", "end").unionByName(runs)


def personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id``, count of each base kind, digest of the base spans, and all spans of every row.

    Spans are ``kind:start:end`` in code points, by start and then kind; kinds that are not in :data:`BASE_KINDS` are the
    method's, and its spans never overlap a base span.  A null text is empty and has none; rows that
    are alike get the same spans, once.  Other columns are ignored.
    """
    rows = documents.select("doc_id", text_of().alias("text"), digest(F.col("doc_id"), F.col("text")).alias("id"))
    votes = (c.alias(n) for n, c in _votes().items())
    spans = stored(find_spans(rows).select("id", "kind", "n", "start", "end", *votes), "spans")
    base = F.col("kind") < len(BASE_KINDS)
    models = train(spans.filter(~base))
    sure = spans.filter(~base).withColumn("chance", chance(models)).filter(F.col("chance") >= SURE)
    spans = spans.filter(base).select("id", "kind", "start", "end").unionByName(_apart(sure))
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    found = spans.groupBy("id").agg(
        *(F.count(F.when(F.col("kind") == n, 1)).alias(f"n_{kind}") for n, kind in enumerate(BASE_KINDS)),
        listed.alias("spans"),
    )
    names = F.array(*map(F.lit, KINDS))
    text = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    found = rows.select("doc_id", "id").join(found, "id", "left")
    of_base = joined(F.filter("spans", lambda x: x["kind"] < len(BASE_KINDS)))
    return found.select(
        "doc_id",
        *(F.coalesce(f"n_{kind}", F.lit(0)).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(F.coalesce(of_base, F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("spans")), F.lit("")).alias("spans"),
    )


@query("op1_weak_supervision_pii")
def op1_weak_supervision_pii(spark, sf):
    return personal_data(load(spark, sf, "documents"))
