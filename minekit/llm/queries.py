"""The registered queries of the operators, each over its whole table, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.llm import bpe, language, licences, lm, merkle, near_dedup, prefix_bpe, secrets, simhash, substrings, urls, whitening
from minekit.llm import decontaminate as bench
from minekit.scale import settle

RANKS = "byte_bpe_multi_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@register
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, folder))


@register
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, folder)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    tokens = bpe.read_ranks(public_tokenizers.path(RANKS))
    coded = bpe.encode_decode(docs, tokens, public_tokenizers.PATTERN, with_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    prototypes = language.train(docs.where(~language.held_out("doc_id")))
    named = language.predict(docs.select("doc_id", "text"), prototypes, keep=["doc_id"])
    return named.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@register
def op4_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(documents(spark, folder), language.held_out("doc_id", 7, 2))


@register
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    marked = bench.find_items(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), keep=["doc_id"])
    return marked.select(
        "doc_id",
        "n_words",
        bench.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op5_decontamination"] = f"""
with d as (select doc_id, coalesce({_WORDS}, []) w from documents),
b as (select item_id::varchar item, {_WORDS} w from benchmark where text is not null and item_id is not null),
bw as (
    select distinct item, least(10, len(w)) n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') g
    from (select item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i from b where len(w) > 0)
),
sizes as (select distinct n from bw),
dp as (select doc_id, w, unnest(range(1, len(w) + 1)) i from d),
dw as (select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') g from dp, sizes where i + n - 1 <= len(w)),
hit as (select doc_id, i, bw.n n, item from dw join bw on dw.n = bw.n and dw.g = bw.g),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1),
items as (
    select doc_id, count(*) n_items, string_agg(item, ',' order by item) s
    from (select distinct doc_id, item from hit) group by 1
)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
    sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""


@register
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, folder).select("doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed("secrets", base_only=True).cast("binary"), 256).alias("base_sha256"),
        secrets.listed("secrets").alias("spans"),
    )


@register
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return urls.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _url_sql() -> str:
    fits = [
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then {{'rule': '{h}{p}', 'verdict': '{v}'}}"
        for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    n, keys = urls.LEVELS, ["host"]
    levels, source = [], "shapes"
    for i in range(1, n + 1):
        k = ", ".join(keys)
        levels.append(
            f"""
b{i} as (select {k}, s{i}, sum(urls) u, sum(blocked) b, sum(blocked + allowed) j from {source} group by all),
w{i} as (
    select *, sum(b) over p ab, sum(j) over p aj from b{i} window p as (partition by {k})
),
n{i} as (
    select {k}, s{i}, case when s{i} = '' or (u >= {urls.SUPPORT} and coalesce(
        abs(b / nullif(j, 0) - (ab - b) / nullif(aj - j, 0))
        > {urls.Z} * sqrt((ab / nullif(aj, 0)) * (1 - ab / nullif(aj, 0)) * (1.0::double / nullif(j, 0) + 1.0::double / nullif(aj - j, 0))), false))
        then s{i} else '*' end t{i} from w{i}
),
a{i} as (select * from {source} join n{i} using ({k}, s{i})),"""
        )
        source, keys = f"a{i}", [*keys, f"t{i}"]
    k, s = ", ".join(keys), ", ".join(f"s{i}" for i in range(1, n + 1))
    part = "coalesce(string_split(path, '/')[{}], '')"
    shape = ", ".join(f"case when regexp_matches({part.format(i + 1)}, '[0-9]') then '*' else {part.format(i + 1)} end s{i}" for i in range(1, n + 1))
    return f"""
with u as (
    select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_LETTERS}', '{_LETTERS.lower()}') host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages
),
r as (select *, case {" ".join(fits)} else null end r, {shape} from u),
shapes as (
    select host, {s}, count(*) urls, count(*) filter (r.verdict = 'block') blocked, count(*) filter (r.verdict = 'allow') allowed
    from r group by all
),{"".join(levels)}
leaf as (select {k}, sum(blocked)::double b, sum(allowed)::double a from {source} group by all),
h as (select host, sum(b) hb, sum(a) ha from leaf group by 1),
g as (select coalesce(sum(hb) / nullif(sum(hb) + sum(ha), 0), 0) share from h),
p as (
    select {k}, (b + {urls.WEIGHT} * (hb + {urls.WEIGHT} * share) / (hb + ha + {urls.WEIGHT})) / (b + a + {urls.WEIGHT}) purity
    from leaf join h using (host), g
),
v as (select host, {s}, case when round(purity, 9) > {urls.PURITY} then 'block' else 'allow' end verdict from {source} join p using ({k}))
select page_id, host, path, r.r.rule "rule", coalesce(r.r.verdict, v.verdict) verdict from r left join v using (host, {s})
"""


SQL["op8_url_filter"] = _url_sql()


@register
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    prints = settle(simhash.fingerprint_edits(documents(spark, folder)))
    classes = simhash.fingerprint_classes(prints)
    return prints.join(classes, "fingerprint").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"),
        simhash.hexadecimal(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        simhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        simhash.hexadecimal(F.col("class")).alias("near_class"),
    )


@register
def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.find_licences(documents(spark, folder).select("doc_id", "text"))
    place = F.transform(
        "licences", lambda m: F.concat_ws(":", m["licence"], m["first_line"].cast("string"), m["last_line"].cast("string"), F.format_string("%.6f", m["dice"]))
    )
    return found.select("doc_id", F.size("licences").cast("long").alias("n_passages"), F.concat_ws(",", place).alias("passages"))


def _licence_sql() -> str:
    known, _ = licences.prepared(licences.TEMPLATES, licences.LIMIT)
    t, rows = licences.LIMIT, ", ".join("({}, '{}', [{}])".format(-i, n, ", ".join(f"'{g}'" for g in b)) for i, (n, b) in enumerate(known))
    telling = ", ".join(f"'{w}'" for w in licences.prepared(licences.TEMPLATES, licences.LIMIT)[1])
    return f"""
with templates(o, licence, grams) as (values {rows}),
l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 i from documents),
w as (select doc_id, i, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+') w from l),
m as (select *, i - row_number() over (partition by doc_id order by i) run from w where list_has_any(w, [{telling}])),
p as (
    select doc_id, i a, i z, w from m
    union all
    select doc_id, min(i), max(i), flatten(list(w order by i)) from m group by doc_id, run having count(*) > 1
),
g as (select doc_id, a, z, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) g, len(w) n, w from p),
h as (select doc_id, a, z, case when n = 1 then w else g end g from g),
d as (
    select doc_id, a, z, licence, o, round(2.0 * len(list_intersect(h.g, grams)) / (len(h.g) + len(grams)), 9) dice from h, templates
    where len(h.g) between len(grams) * {t / (2 - t)} - 1e-9 and len(grams) * {(2 - t) / t} + 1e-9
),
b as (select * from d where dice >= {t} qualify row_number() over (partition by doc_id, a, z order by dice desc, o desc) = 1),
s as (select doc_id, count(*) n, string_agg(licence || ':' || a || ':' || z || ':' || printf('%.6f', dice), ',' order by a, z) p from b group by 1)
select doc_id, coalesce(n, 0)::bigint n_passages, coalesce(p, '') passages from documents left join s using (doc_id)
"""


SQL["op10_licences"] = _licence_sql()


@register
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars"]
    lower = F.translate("text", _LETTERS, _LETTERS.lower())
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.digest(merkle.record([*fields, lower])))
    leaves = merkle.manifest(documents(spark, folder), fields=[*fields, "text"], carry={"tampered": tampered})
    back = merkle.folded(F.coalesce("tampered", "leaf"), "proof")
    proved = leaves.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings("proof")).alias("proof_sha256"), back.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _manifest_sql() -> str:
    field = "coalesce(octet_length(encode({0}::varchar)) || ':' || {0}::varchar, '-')"
    fields = [field.format(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = field.format(f"translate(text, '{_LETTERS}', '{_LETTERS.lower()}')")
    flipped = "xor(a, x)"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: "
        f"[ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor({flipped} >> 1, case when {flipped} & 1 = 1 then 3988292384 else 0 end)))"
    )
    levels, steps = range(6), []
    for t in "lt":  # the leaves of each source, then the roots of the sources
        if t == "t":
            steps.append("t0 as (select '' k, row_number() over (order by k) - 1 pos, count(*) over () n, h, k name from l6)")
        for i in levels:
            steps.append(
                f"{t}{i + 1} as (select k, pos // 16 pos, n, case when n > {16**i} then sha256(string_agg(h, '' order by pos)) else min(h) end h"
                f"{', min(name) as name' if t == 't' else ''} from {t}{i} group by k, pos // 16, n)"
            )
            steps.append(
                f"{t}s{i} as (select a.k, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') l,"
                f" coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') r"
                f" from {t}{i} a join {t}{i} b on a.k = b.k and a.pos // 16 = b.pos // 16 group by 1, 2)"
            )
    joins = " ".join(f"join {t}s{i} on {t}s{i}.k = {t}0.k and {t}s{i}.pos = {t}0.pos // {16**i}" for t in "lt" for i in levels)
    proof = " || ".join(f"{t}s{i}.l || {t}s{i}.r" for t in "lt" for i in levels)
    pairs = ", ".join(f"case when {t}0.n > {16**i} then {t}s{i}.l || '|' || {t}s{i}.r end" for t in "lt" for i in levels)
    pairs = f"list_filter([{pairs}], lambda p: p is not null)"
    fold = f"list_reduce(list_prepend(f, {pairs}), lambda a, p: sha256(split_part(p, '|', 1) || a || split_part(p, '|', 2)))"
    return f"""
with d as (
    select doc_id, coalesce('1' || source, '0') k, sha256({" || ".join([*fields, field.format("text")])}) h,
        case when {crc} % 5 = 0 then sha256({" || ".join([*fields, lower])}) end tampered
    from documents
),
l0 as (select *, row_number() over (partition by k order by doc_id nulls first, h) - 1 pos, count(*) over (partition by k) n, coalesce(tampered, h) f from d),
{", ".join(steps)}
select doc_id, l0.h leaf, l6.h subroot, t6.h root, sha256({proof}) proof_sha256, {fold} folded_root, folded_root = t6.h verified
from l0 join l6 on l6.k = l0.k join t0 on t0.name = l0.k cross join t6 {joins}
"""


SQL["op11_merkle_manifest"] = _manifest_sql()


@register
def op13_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = prefix_bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    coded = prefix_bpe.encode_decode(documents(spark, folder).select("doc_id", "text"), vocabulary, with_ids=False, keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, model.explained)) if model else F.array().cast("array<double>")
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, "at").alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
