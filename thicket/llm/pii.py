"""Personal data by weak supervision, in DataFrame and SQL functions only.

Patterns give the base spans: email, ip, card, phone. Looser patterns add candidates: spelt-out emails, phones without a
plus, cards that fail Luhn, numbers of 3, 2 and 4 digits, titled names. On every candidate three labelers vote:

* regex: the strict form of its kind (1) or not (0): as a base pattern has it, dotted quads without leading zeros, local phones with
  area and exchange from 2 up, hyphenated social security numbers without void parts, a title with two names;
* gazetteer: known top-level domains, issuers' digits, area codes, issued areas, first names (1) or not (0);
* context: a word of its kind (2), a contrary word (1) or neither (0) in the ``CONTEXT`` characters before it, back to the fourth match of
  its pattern before.

Spark counts the vote patterns of each kind (twelve at most). Expectation-maximisation over these counts estimates each
labeler's reliability and each pattern's probability; where the votes tell nothing, it stays where it began. The candidates, labelled by these probabilities, train the final
classifier, naive Bayes over hashed features: the word before, the shape, the length. A candidate that is no base span is kept if
both the votes' probability and the classifier's reach ``KEEP``. Base spans stay. Both models work on shares, so a table and many
copies of it give the same decisions.

Everything about a document stays in its row: texts are never shuffled, and the models are arrays of fixed size. The work on one text
grows with its length and, for its n matches, with n to the power 1.5 at most, of which a match's share is a copy of a few bytes.

Defined cases: null and empty texts have no spans. Positions are code points, ends exclusive. Rows that repeat are each judged.
Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import materialise

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "person")
CONTEXT, BUCKETS, ROUNDS, KEEP = 40, 512, 25, 0.9
FEATURES = 3
LEAST = "1e-9D"  # share that keeps quotients finite

# Fixed patterns. \G and the look-behinds only keep Java from trying every place of a run again; the matches are the same.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
SPELT = r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{1,63}){1,5}"
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![0-9A-Za-z+/_.-])(?<![0-9] )[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{4}(?![0-9A-Za-z+/_=-])(?![ .][0-9])"
PERSON = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}\p{Ll}{1,20}(?: \p{Lu}\p{Ll}{1,20})?(?!\p{Ll})"
# Strict forms.
STRICT_IP = r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$"
STRICT_PHONE = r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$"
STRICT_SSN = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
STRICT_PERSON = r"^[A-Z][a-z]+\.? \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$"
# Fixed word lists, common ones. Areas of social security numbers as issued until 2011, less the numbers that advertisements made known.
TOP_LEVEL = (
    "com org net edu gov mil int io dev app info biz name pro eu uk us ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg hr si rs se no dk fi is ee lv lt ru ua tr il ae in cn jp kr sg hk tw th vn my id "
    "ph br ar mx cl co pe uy za ng ke eg ma ai tv me cc xyz online site tech shop blog cloud"
)
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
AREAS = r"^(?!078051120|219099999)(?:00[1-9]|0[1-9][0-9]|[1-5][0-9]{2}|6[0-57-9][0-9]|66[0-57-9]|7[0-2][0-9]|73[0-3]|7[56][0-9]|77[0-2])"
FIRST_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Betty Mark Margaret Paul Sandra "
    "Steven Ashley Andrew Emily Kenneth Donna George Michelle Kevin Carol Brian Amanda Edward Laura Peter Anna Emma Olivia Sophie Alice Jack Harry Oliver Grace Helen Jane Kate Lucy Ben Sam Tom Max Leon Lukas Jonas Felix Paula "
    "Hans Karl Klaus Jürgen Wolfgang Stefan Andreas Sabine Monika Petra Ursula Heike Julia Katharina Pierre Jean Marie Claire Camille Louis Antoine Nicolas Julien Sophia Isabelle Nathalie Philippe François Luc Léa Chloé "
    "Carlos Juan José Luis Miguel Javier Antonio Manuel Pablo Diego María Ana Carmen Isabel Lucía Sofía Sofia Elena Marta Rosa Maria Marco Luca Giulia Chiara Francesca Ivan Olga Natalia Ahmed Fatima Mohammed Ali Wei Yuki Hiroshi Priya Raj"
)
WORDS = {
    "email": ("e-?mail|mail|contact|write", "import|decorator"),
    "ip": ("ip|address|host|server|addr", "version|release|section|chapter"),
    "card": ("card|visa|mastercard|amex|payment", "order|invoice|isbn|serial|tracking"),
    "phone": ("phone|tel|call|mobile|fax|whatsapp", "order|invoice|isbn|serial|version"),
    "ssn": ("ssn|social security|security number", "part|serial|order|date"),
    "person": ("name|patient|signed|dear|by", "street|avenue"),
}


def _places(text: str, pattern: str, maybe: str) -> str:
    """SQL for the matches of a pattern in a text: array of (m, start, end, before), leftmost and non-overlapping; ``before`` is the
    context: the text ahead, as far back as the fourth match before. The pieces between matches give positions: their running sums are made block by
    block, as many blocks as a block has places, so that no long array is copied for each match. ``maybe``: SQL that is false
    only for texts without a match."""
    p = "r'" + pattern.replace("'", r"\x27") + "'"
    none = "CAST(array() AS array<struct<m: string, start: int, end: int, before: string>>)"
    pieces = f"zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (m, gap) -> struct(m, gap))"
    # the last piece is what follows the last match
    numbered = f"transform(filter({pieces}, x -> x.m IS NOT NULL), (x, i) -> struct(x.m AS m, x.gap AS gap, length(x.gap) + length(x.m) AS n))"
    blocks = "transform(sequence(0, (size(z) - 1) div w), b -> slice(z, b * w + 1, w))"
    # a row of (places ahead of the block, running places inside)
    inside = "transform({blocks}, g -> aggregate(g, array(0), (a, x) -> array_append(a, a[size(a) - 1] + x.n)))"
    starts = "aggregate(s, array(0), (a, g) -> array_append(a, a[size(a) - 1] + g[size(g) - 1]))"
    context = " || ".join(f"CASE WHEN i >= {k} THEN {'z[i - ' + str(k) + '].gap || z[i - ' + str(k) + '].m'} ELSE '' END" for k in (4, 3, 2, 1))
    near = f"right(CASE WHEN length(z[i].gap) >= {CONTEXT} THEN z[i].gap ELSE {context} || z[i].gap END, {CONTEXT})"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    ends = "t[i div w] + s[i div w][i % w + 1]"
    found = f"transform(z, (x, i) -> struct(x.m AS m, {ends} - length(x.m) AS start, {ends} AS end, {near} AS before))"
    body = let("z", numbered, f"CASE WHEN size(z) = 0 THEN {none} ELSE " + let("w", "int(ceil(sqrt(size(z))))", let("s", inside.format(blocks=blocks), let("t", starts, found))) + " END")
    return f"CASE WHEN {maybe} THEN {body} ELSE {none} END"


def _meets(spans: str) -> str:
    """SQL: whether the span x meets one of ``spans``, which are in order and apart: a search by halves for the first that ends after x
    begins."""
    step = f"CASE WHEN r.a >= r.b THEN r WHEN {spans}[shiftright(r.a + r.b, 1)].end > x.start THEN named_struct('a', r.a, 'b', shiftright(r.a + r.b, 1)) ELSE named_struct('a', shiftright(r.a + r.b, 1) + 1, 'b', r.b) END"
    first = f"aggregate(sequence(1, int(ceil(log2(size({spans}) + 1))) + 1), named_struct('a', 0, 'b', size({spans})), (r, _) -> {step}, r -> r.a)"
    return f"(size({spans}) > 0 AND coalesce(get({spans}, {first}).start < x.end, false))"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    """SQL: the digits of m, from the right, every second one doubled, add up to a multiple of ten."""
    d = _digits(m)
    return f"""aggregate(transform(split(reverse({d}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN coalesce(try_cast(c AS int), 0)
        ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), coalesce(try_cast(c AS int), 0) + 1) END), 0, (s, v) -> s + v) % 10 = 0"""


def _tag(kind: str, base: bool, source: str, keep: str = "true") -> str:
    number = KINDS.index(kind)
    return f"transform(filter({source}, x -> {keep}), x -> struct({number} AS kind, {str(base).lower()} AS base, x.m AS m, x.start AS start, x.end AS end, x.before AS before))"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and cands, an array of (kind, base, m, start, end, votes, features) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    found = {
        "emails": (EMAIL, "instr(t, '@') > 0"),
        "ips": (IP, r"t RLIKE r'[0-9]\.[0-9]'"),
        "cards": (CARD, "t RLIKE r'[0-9](?:[ -]?[0-9]){12}'"),
        "phones": (PHONE, "instr(t, '+') > 0"),
        "spelt": (SPELT, r"t RLIKE r'[(\[]at[)\]]'"),
        "locals": (LOCAL_PHONE, "t RLIKE r'[0-9]{3}[ .-][0-9]{4}'"),
        "ssns": (SSN, "t RLIKE r'[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{4}'"),
        "people": (PERSON, r"t RLIKE r'(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}'"),
    }
    rows = rows.withColumns({name: F.expr(_places("t", pattern, maybe)) for name, (pattern, maybe) in found.items()})
    size = f"length({_digits('x.m')})"
    card = f"{size} BETWEEN 13 AND 19"
    base = {
        "email": _tag("email", True, "emails"),
        "ip": _tag("ip", True, "ips", f"x.m RLIKE r'{IP_PARTS}'"),
        "card": _tag("card", True, "cards", f"{card} AND {_luhn('x.m')}"),
        "phone": _tag("phone", True, "phones", f"{size} BETWEEN 9 AND 15"),
    }
    loose = [
        _tag("email", False, "spelt"),
        _tag("card", False, "cards", f"{card} AND NOT {_luhn('x.m')}"),
        _tag("phone", False, "locals"),
        _tag("ssn", False, "ssns"),
        _tag("person", False, "people"),
    ]
    rows = rows.withColumns({f"base_{k}": F.expr(v) for k, v in base.items()})
    meets = " OR ".join(_meets(f"base_{k}") for k in base)
    free = f"filter(concat({', '.join(loose)}), x -> NOT ({meets}))"
    own = ", ".join(f"base_{k}" for k in base)
    return rows.select("doc_id", F.expr(f"transform(concat({own}, {free}), x -> {_votes()})").alias("cands"))


def _votes() -> str:
    """SQL: the candidate x of a text t with its labelers' votes and its features."""
    d, before = _digits("x.m"), "lower(x.before)"
    by_kind = lambda options: "CASE x.kind " + " ".join(f"WHEN {KINDS.index(k)} THEN {v}" for k, v in options.items()) + " ELSE 0 END"
    regex = by_kind(
        {
            "email": "int(x.base)",
            "ip": f"int(x.m RLIKE r'{STRICT_IP}')",
            "card": "int(x.base)",
            "phone": f"int(x.base OR x.m RLIKE r'{STRICT_PHONE}')",
            "ssn": f"int(x.m RLIKE r'{STRICT_SSN}')",
            "person": f"int(x.m RLIKE r'{STRICT_PERSON}')",
        }
    )
    gazetteer = by_kind(
        {
            "email": f"int(x.m RLIKE r'(?i)[. ](?:{TOP_LEVEL.replace(' ', '|')})$')",
            "ip": r"int(NOT x.m RLIKE r'^0*(?:0|127|255)\.')",
            "card": f"int({d} RLIKE r'{ISSUER}')",
            "phone": f"int({d} RLIKE r'^1?[2-9][0-9]{{9}}$')",
            "ssn": f"int({d} RLIKE r'{AREAS}')",
            "person": rf"int(x.m RLIKE r'(?U)\b(?:{FIRST_NAMES.replace(' ', '|')})\b')",
        }
    )
    context = by_kind({k: rf"CASE WHEN {before} RLIKE r'\b(?:{good})\b' THEN 2 WHEN {before} RLIKE r'\b(?:{bad})\b' THEN 1 ELSE 0 END" for k, (good, bad) in WORDS.items()})
    word = rf"regexp_extract({before}, r'([^ ]+)[^\p{{L}}\p{{N}}]*$', 1)"
    shape = "regexp_replace(regexp_replace(x.m, '[0-9]', '9'), '[A-Za-z]+', 'a')"
    return f"""named_struct('kind', x.kind, 'base', x.base, 'start', x.start, 'end', x.end,
        'v1', {regex}, 'v2', {gazetteer}, 'v3', {context},
        'f', array(pmod(hash({word}), {BUCKETS}), pmod(hash({shape}), {BUCKETS}), least(x.end - x.start, {BUCKETS - 1})))"""


def reliabilities(cands: DataFrame) -> DataFrame:
    """By expectation-maximisation over vote patterns: a row of each kind with p, the patterns (v1, v2, v3, c), and q, the
    probability of each. ``cands`` has a row for each candidate."""
    patterns = cands.groupBy("kind", "v1", "v2", "v3").agg(F.count(F.lit(1)).cast("double").alias("c"))
    # twelve patterns of a kind at most
    kinds = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("v1", "v2", "v3", "c"))).alias("p"))
    total = "aggregate(z, 0D, (s, j) -> s + j.p.c * {w})"
    part = "aggregate(filter(z, j -> j.p.{v} = x.{v}), 0D, (s, j) -> s + j.p.c * ({w} + {least}))"
    every = "aggregate(z, 0D, (s, j) -> s + j.p.c)"
    # a vote is smoothed towards its share of the kind, by a share: evenly would push constant votes' probabilities up, the more the fewer rows
    chance = {}
    for name, w in (("yes", "j.q"), ("no", "(1 - j.q)")):
        n = total.format(w=w)
        chance[name] = n + "".join(f" * {part.format(v=v, w=w, least=LEAST)} / ({n} + {LEAST} * {every})" for v in ("v1", "v2", "v3"))
    step = f"""(q, _) -> transform(arrays_zip(p, q), e -> transform(array(e.p), x -> transform(array(arrays_zip(p, q)),
        z -> {chance['yes']} / ({chance['yes']} + {chance['no']}))[0])[0])"""
    # over KEEP where all three agree, as nothing may move it
    begin = "transform(p, x -> 0.05D + 0.9D * (x.v1 + x.v2 + CASE x.v3 WHEN 2 THEN 1D WHEN 1 THEN 0D ELSE 0.5D END) / 3D)"
    return kinds.withColumn("q", F.expr(f"aggregate(sequence(1, {ROUNDS}), {begin}, {step})"))


def classifier(cands: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row: votes (probability by kind and vote pattern), prior (log odds by kind), weights (log odds by kind, feature and
    bucket), each a flat array of fixed size. Trained by candidates weighted with the probabilities in ``kinds``."""
    flat = kinds.select("kind", F.explode(F.arrays_zip("p", "q")).alias("e")).select("kind", "e.p.v1", "e.p.v2", "e.p.v3", "e.q", "e.p.c")
    code = "kind * 12 + v1 * 6 + v2 * 3 + v3"
    # the patterns number 12 x kinds at most
    known = flat.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.expr(code), "q"))).alias("known"), F.collect_list(F.struct("kind", "q", "c")).alias("all"))
    votes = F.expr(f"transform(sequence(0, {12 * len(KINDS) - 1}), i -> coalesce(known[i], 0D))")
    part = "aggregate(filter(all, e -> e.kind = k), 0D, (s, e) -> s + ({w} + {least}) * e.c)"
    prior = F.expr(f"transform(sequence(0, {len(KINDS) - 1}), k -> CASE WHEN exists(all, e -> e.kind = k) THEN ln({part.format(w='e.q', least=LEAST)} / {part.format(w='(1 - e.q)', least=LEAST)}) ELSE 0D END)")
    by_row = cands.join(flat.drop("c"), ["kind", "v1", "v2", "v3"])
    sums = by_row.select("kind", "q", F.posexplode("f").alias("n", "b")).groupBy("kind", "n", "b").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
    totals = sums.groupBy("kind", "n").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    # a bucket's odds are drawn towards the kind's by as many candidates as a bucket has on average
    all_ = F.col("all_yes") + F.col("all_no")
    odds = F.log((F.col("yes") + F.col("all_yes") / BUCKETS + F.expr(LEAST) * all_) / (F.col("no") + F.col("all_no") / BUCKETS + F.expr(LEAST) * all_))
    odds = odds - F.log((F.col("all_yes") + F.expr(LEAST) * all_) / (F.col("all_no") + F.expr(LEAST) * all_))
    place = (F.col("kind") * FEATURES + F.col("n")) * BUCKETS + F.col("b")
    weights = sums.join(totals, ["kind", "n"]).groupBy().agg(F.map_from_entries(F.collect_list(F.struct(place.alias("i"), odds.alias("w")))).alias("w"))
    one = known.select(votes.alias("votes"), prior.alias("prior"), F.lit(1).alias("one")).join(weights.withColumn("one", F.lit(1)), "one", "left")
    return one.select("votes", "prior", F.coalesce("w", F.expr("CAST(map() AS map<int, double>)")).alias("w"))


def find(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, spans (kind, start, end) of each row of ``docs`` (doc_id, text), by kind as listed, then start, and base, those that
    the patterns alone give."""
    rows = materialise(candidates(docs), "pii-candidates")
    cands = rows.select(F.explode("cands").alias("x")).select("x.*")
    model = materialise(classifier(cands, reliabilities(cands)), "pii-model")
    names = ", ".join(f"'{k}'" for k in KINDS)
    odds = f"prior[x.kind] + aggregate(transform(x.f, (b, n) -> coalesce(w[(x.kind * {FEATURES} + n) * {BUCKETS} + b], 0D)), 0D, (s, v) -> s + v)"
    kept = f"x.base OR (votes[x.kind * 12 + x.v1 * 6 + x.v2 * 3 + x.v3] >= {keep} AND 1 / (1 + exp(-({odds}))) >= {keep})"
    spans = f"transform(array_sort(transform(filter(cands, x -> {{}}), x -> struct(x.kind AS k, x.start AS start, x.end AS end))), s -> struct(element_at(array({names}), s.k + 1) AS kind, s.start AS start, s.end AS end))"
    return rows.sparkSession.sql(
        f"""SELECT doc_id, {spans.format(kept)} AS spans, {spans.format("x.base")} AS base FROM
        (SELECT doc_id, cands, (SELECT votes FROM {{model}}) AS votes, (SELECT prior FROM {{model}}) AS prior, (SELECT w FROM {{model}}) AS w FROM {{rows}})""",
        rows=rows,
        model=model,
    )
