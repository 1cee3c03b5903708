"""Secret scanning: fixed patterns, and character Markov models for strings that no pattern knows (DataFrame functions only).

Two first-order Markov models over characters, one trained on labelled random strings and one on ordinary identifiers, score a candidate;
its log-likelihood ratio per transition in thousandths of a nat must exceed a threshold. Candidates are runs of 20 or more characters of
``[A-Za-z0-9+/_=-]`` in what the patterns leave: their matches count as dots. Of a run that doesn't pass, the parts between / and = of 20 or
more characters are candidates too. The model is a table of whole numbers by pairs of characters, learnt by counting in Spark.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import running

#: The kinds in the order in which they are listed, their patterns, and the least length of what counts.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = [("assign", ASSIGN, 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24), ("markov", "[A-Za-z0-9+/_=-]{20,}", 20)]
#: Only runs that can count are looked for where that gives the same matches.
QUICK = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}

#: Candidates: whole runs, and their parts.
RUN, PART = KINDS[3][1], "[A-Za-z0-9+_-]{20,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SIZE = len(ALPHABET) + 1  # and any other character

#: Labelled samples: ordinary identifiers as they are, and words from which more are made.
ORDINARY = """
getUserNameFromSession maxRetryCount2 is_valid_email_address background_color_primary handleButtonClickEvent customer_account_number
parse_http_response_v2 DatabaseConnectionPool2 total_amount_after_tax2023 createOrUpdateRecord com_example_application_main
AbstractSingletonProxyFactoryBean org/apache/commons/lang3/StringUtils usr/local/share/applications/version2 INVALID_ARGUMENT_ERROR_404
test_should_return_200_when_ok application/x-www-form-urlencoded text-align-center-md-6 btn-primary-outline-large col-xs-12-col-md-8
data-toggle-collapse-menu-2 user_profile_picture_url_large first_name_last_name_index2 ConfigurationManagerImpl1 monthly_report_2023_final_version
chapter-12-the-return-of-the-king annual-general-meeting-2021-minutes img/products/large/summer-collection-2019 src/main/java/com/example/demo/Main1
MAX_CONNECTIONS_PER_HOST_64 left_outer_join_on_customer_id iso8859-1_encoding_table utf8_general_collation_ci window_function_row_number1
quarterly_revenue_by_region_q3 internationalization_locale_en kubernetes_deployment_replicas3 continuous-integration-pipeline-stage4
machine_learning_training_set_v10 convolutional_layer_3x3_stride2 attention_head_output_weights12 learning_rate_warmup_steps1000
northern-hemisphere-winter-2020 questions-and-answers-part-1 photographs/holiday/beach/2018/august README_for_new_developers_v3
-------------------------------- ================================ ________________________________ ++++++++++++++++++++++++++++++++
//////////////////////////////// -=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-= 00000000000000000000000000000000 1234567890123456789012345678901234567890
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdefghijklmnopqrstuvwxyz 2024-01-01-00-00-00-000000 xxxxxxxxxxxxxxxxxxxxxxxx
""".split()
WORDS = """
the and for with this that from have not are was you all can will one time year people way day man thing world life hand part child
eye place work week case point government company number group problem fact value error index user name file path type list table query key
string object class method function return create update delete insert select order customer account message event handler manager service
request response server client config default option parameter version system network database connection session cache buffer stream
der die und nicht eine werden haben sich auch noch nach gesellschaft versicherung verwaltung geschichte wirtschaft freundschaft
les des une pour dans avec qui sur plus tout comme mais leur bien cette toujours gouvernement developpement connaissance
los las una por para con como pero todo esta desde cuando muy sobre tambien hasta desarrollo gobierno conocimiento
""".split()


def _identifier(i: int) -> str:
    """An ordinary identifier of 20 characters or more: words in one of the usual styles, some with a number."""
    draws = hashlib.sha256(f"identifier {i}".encode()).digest() * 2
    words, k = [], 2
    while sum(map(len, words)) < 20:
        words.append(WORDS[(draws[k] * 256 + draws[k + 1]) % len(WORDS)])
        k += 2
    number = ["", "", "2", "10", "2023", "v3"][draws[0] % 6]
    join = {0: "_".join, 1: "-".join, 2: "/".join, 3: "".join}
    style = draws[1] % 8
    if style < 4:
        return join[style](words) + number
    if style == 4:
        return "_".join(words).upper() + number
    camel = "".join(w.title() for w in words) + number
    return camel[0].lower() + camel[1:] if style == 5 else camel if style == 6 else "-".join(w.title() for w in words) + number


def _random(i: int) -> str:
    """A random string of 40 characters at most: base 64, its form for addresses, base 32, hex, base 62, letters, or small letters and digits."""
    digest = hashlib.sha256(f"sample {i}".encode()).digest()
    kind = i % 7
    if kind < 4:
        made = (base64.b64encode(digest), base64.urlsafe_b64encode(digest), base64.b32encode(digest), digest.hex().encode())[kind]
        return made.decode()[:40]
    signs = (ALPHABET[:62], ALPHABET[:52], ALPHABET[:26] + ALPHABET[52:62])[kind - 4]
    n, out = int.from_bytes(digest, "big"), ""
    while len(out) < 40:
        n, k = divmod(n, len(signs))
        out += signs[k]
    return out


def labelled(random: int = 1400, ordinary: int = 1200) -> list[tuple[str, bool]]:
    """(token, random) rows to train from: so many random strings and made identifiers, and the listed identifiers in three letter cases."""
    rows = [(_random(i), True) for i in range(random)] + [(_identifier(i), False) for i in range(ordinary)]
    for x in ORDINARY:
        rows += [(x, False), (x.lower(), False), (x.title(), False)]
    return rows


def samples(spark: SparkSession, random: int = 1400, ordinary: int = 1200) -> DataFrame:
    """The labelled rows as a DataFrame (token string, random boolean)."""
    rows = json.dumps([{"token": t, "random": r} for t, r in labelled(random, ordinary)])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<token: string, random: boolean>>")))


#: What is added to each count.
LEAST = 0.5


def char_class(c: Column) -> Column:
    """0 for characters outside the alphabet, else its place from 1."""
    return F.instr(F.lit(ALPHABET), c)


def _weights(counts: dict[tuple[bool, int, int], int]) -> list[int]:
    """Thousandths of a nat for each pair of classes, with a share of a count added to each."""
    out = []
    for a in range(SIZE):
        sums = [sum(counts.get((kind, a, b), 0) for b in range(SIZE)) for kind in (True, False)]
        for b in range(SIZE):
            p, q = ((counts.get((kind, a, b), 0) + LEAST) / (sums[k] + LEAST * SIZE) for k, kind in enumerate((True, False)))
            out.append(round(1000 * math.log(p / q)))
    return out


def train(labelled: DataFrame) -> list[int]:
    """The table of weights from (token string, random boolean). Counted in Spark; at most 2 * 66**2 counts come to the driver."""
    at = F.sequence(F.lit(1), F.length("token") - 1)
    pairs = labelled.where(F.length("token") > 1).select("random", F.explode(F.transform(at, lambda i: F.substr("token", i, F.lit(2)))).alias("two"))
    counts = pairs.groupBy("random", char_class(F.substring("two", 1, 1)).alias("a"), char_class(F.substring("two", 2, 1)).alias("b")).count()
    return _weights({(r["random"], r["a"], r["b"]): r["count"] for r in counts.collect()})


def sample_weights() -> list[int]:
    """The same table from the same samples without Spark, for the SQL."""
    counts: dict[tuple[bool, int, int], int] = {}
    for token, random in labelled():
        for x, y in zip(token, token[1:], strict=False):
            key = (random, ALPHABET.find(x) + 1, ALPHABET.find(y) + 1)
            counts[key] = counts.get(key, 0) + 1
    return _weights(counts)


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches, leftmost and not overlapping, and the texts before, between and behind them."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern)


def _spans(text: Column, kind: str, pattern: str, accept) -> Column:
    """struct(start, rank, kind, end) of the matches that count. Places are running sums of the lengths of matches and what parts them."""
    rank = [k for k, *_ in KINDS].index(kind)
    hits, gaps = _matches(text, pattern)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    ends = running(lengths, lambda a, b: a + b, F.lit(0))
    spans = F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), h.alias("hit")))
    kept = F.filter(spans, lambda s: accept(s["hit"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))


def _masked(text: Column, pattern: str, accept) -> Column:
    """``text`` with dots for the characters of the matches that count."""
    hits, gaps = _matches(text, pattern)
    dots = F.transform(hits, lambda h: F.when(accept(h), F.repeat(F.lit("."), F.length(h))).otherwise(h))
    return F.array_join(F.zip_with(gaps, F.concat(dots, F.array(F.lit(""))), lambda g, d: F.concat(g, d)), "")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, weights: list[int], threshold: int = 0) -> DataFrame:
    """doc_id and base and markov (arrays of struct(start, rank, kind, end)) of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts have none; rows that repeat a doc_id, or have none, are each answered; an empty table gives an empty result.
    Offsets count code points, ends are exclusive. Whole texts are scanned, however long, in time that grows with length and matches.
    """
    text = F.coalesce("text", F.lit(""))
    table = F.from_json(F.lit(str(list(weights))), "array<int>")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    value = lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6
    every = lambda h: F.lit(True)
    accepts = {"assign": value, "access": every, "hex": every}

    def random(h: Column) -> Column:
        n = F.length(h)
        classes = F.transform(F.slice(F.split(h, ""), F.lit(1), n), char_class)
        pairs = F.zip_with(F.slice(classes, F.lit(1), n - 1), F.slice(classes, F.lit(2), n - 1), lambda a, b: F.get(table, a * SIZE + b))
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x) > threshold * (n - 1)

    base = F.concat(*(F.when(text.rlike(QUICK.get(k, p)), _spans(text, k, QUICK.get(k, p), accepts[k])).otherwise(none) for k, p, _ in KINDS[:3]))
    out = docs.select("doc_id", text.alias("rest"), base.alias("base"))
    for k, p, _ in KINDS[:3]:
        out = out.withColumn("rest", F.when(F.size("base") > 0, _masked(F.col("rest"), QUICK.get(k, p), accepts[k])).otherwise(F.col("rest")))
    found = lambda pattern: F.when(F.col("rest").rlike(pattern), _spans(F.col("rest"), "markov", pattern, random)).otherwise(none)
    out = out.withColumn("runs", found(RUN))
    out = out.withColumn("rest", F.when(F.size("runs") > 0, _masked(F.col("rest"), RUN, random)).otherwise(F.col("rest")))
    return out.select("doc_id", "base", F.concat("runs", found(PART)).alias("markov"))


def secret_report(docs: DataFrame, weights: list[int], threshold: int = 0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    found = secret_spans(docs, weights, threshold)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.size("markov").cast("long").alias("n_markov"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "markov")).alias("spans")
    )


def oracle_sql(weights: list[int], threshold: int = 0) -> str:
    """The same for DuckDB."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    cls = lambda c: f"instr({q(ALPHABET)}, {c})"
    score = f"list_sum(list_transform(range(1, length(h)), lambda i: weights[{cls('h[i]')} * {SIZE} + {cls('h[i + 1]')} + 1])) > {threshold} * (length(h) - 1)"
    value = f"length(regexp_extract(h, {q(ASSIGN)}, 2)) >= 6"
    parts = lambda t, p: f"regexp_extract_all({t}, {q(p)}) AS hits, string_split_regex({t}, {q(p)}) AS gaps"
    ctes = ["d0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]

    def spans(name: str, source: str, kind: str, rank: int, pattern: str, accept: str) -> None:
        before = "(list_sum(list_transform(gaps[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT"
        ctes.append(f"h{name} AS (SELECT doc_id, hits[i] AS h, {before} AS a, a + length(h) AS b FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, {parts('t', pattern)} FROM {source})))")
        ctes.append(f"f{name} AS (SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a, b FROM h{name}, w WHERE {accept})")

    def masked(name: str, source: str, pattern: str, accept: str) -> None:
        one = f"CASE WHEN {accept} THEN repeat('.', length(h)) ELSE h END"
        ctes.append(f"{name} AS (SELECT doc_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda k: gaps[k] || coalesce(dots[k], '')), '') AS t FROM (SELECT doc_id, gaps, list_transform(hits, lambda h: {one}) AS dots FROM (SELECT doc_id, weights, {parts('t', pattern)} FROM {source}, w)))")

    rules = [("assign", ASSIGN, value), ("access", QUICK["access"], "true"), ("hex", QUICK["hex"], "true")]
    for rank, (kind, pattern, accept) in enumerate(rules):
        spans(str(rank), "d0", kind, rank, pattern, accept)
        masked(f"d{rank + 1}", f"d{rank}", pattern, accept)
    spans("3", "d3", "markov", 3, RUN, score)
    masked("d4", "d3", RUN, score)
    spans("4", "d4", "markov", 3, PART, score)
    joined = lambda f: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank){f}, '')"
    return f"""
WITH w AS (SELECT {list(weights)} AS weights), {', '.join(ctes)},
every AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'markov') AS n_markov,
       sha256({joined(" FILTER (kind <> 'markov')")}) AS base_sha256, {joined(' FILTER (kind IS NOT NULL)')} AS spans
FROM d0 LEFT JOIN every USING (doc_id) GROUP BY doc_id
"""
