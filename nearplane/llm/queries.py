"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearplane.llm import decontamination, fingerprints, jaccard_join, language_id, license_scan, secret_scan, source_mixing, substring_dedup, token_output, toxicity
from nearplane.llm._common import read_table

MIX_WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 13
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents"), width=20)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"), 4, 2)
    return language_id.identify_language(docs, language_id.train_dictionaries(docs.where(~held)), held)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = language_id.held_out(F.col("doc_id"), 5, 0)
    return toxicity.score_toxicity(docs, toxicity.train(docs, labels.where(~held)), held)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_source_mixing, op2_decontamination, op3_substring_dedup, op4_fingerprints, op5_license_scan, op6_jaccard_join, op7_secret_scan, op8_language_id, op9_token_output, op10_toxicity, pipeline)
    return {f.__name__: f for f in ops}


_SQL_LEVELS = ("domain", "lang", "source")


def _sql_weight(level: str) -> str:
    return f"case {level} " + " ".join(f"when '{n}' then {w}" for n, w in MIX_WEIGHTS[level].items()) + " else 1 end" if level in MIX_WEIGHTS else "1"


def _sql_deal(depth: int) -> str:
    """One level of the tree: shares of the nodes of that depth from the table share{depth}."""
    own, above = list(_SQL_LEVELS[: depth + 1]), list(_SQL_LEVELS[:depth])
    name, keys = own[-1], ", ".join(own)
    on = f"using ({', '.join(above)})" if above else "on true"
    part = f"partition by {', '.join(above)}" if above else ""
    return f"""
    node{depth} as (select {keys}, sum(supply)::bigint supply, min(w{depth})::bigint w from leaf group by {keys}),
    open{depth} as (select node{depth}.*, s.share budget, coalesce(sum(supply) over (win rows between unbounded preceding and 1 preceding), 0)::bigint bef, sum(w) over (win rows between current row and unbounded following)::bigint aft
        from node{depth} join share{depth} s {on} window win as ({part} order by supply / w, {name})),
    full{depth} as (select *, (budget - bef) * w >= supply * aft as is_full from open{depth}),
    left{depth} as (select *, (budget - sum(case when is_full then supply else 0 end) over ({part}))::bigint lft, sum(case when is_full then 0 else w end) over ({part})::bigint all_w, sum(case when is_full then 0 else w end) over ({part} order by {name} rows between unbounded preceding and current row)::bigint upto from full{depth}),
    share{depth + 1} as (select {keys}, case when is_full then supply else (lft * upto) // all_w - (lft * (upto - w)) // all_w end share from left{depth})"""


_OP1 = rf"""
with doc as (select doc_id, coalesce('domain' || (try_cast(nullif(regexp_extract(coalesce(source, '(none)'), '([0-9]+)$', 1), '') as bigint) % 4), 'domain?') as domain,
        coalesce(lang, '(none)') lang, coalesce(source, '(none)') source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint n_tokens,
        coalesce(doc_id::varchar, '') id, md5(coalesce(text, '')) text_md5 from documents),
    leaf as (select domain, lang, source, sum(n_tokens)::bigint tokens, sum(n_tokens)::bigint * {MIX_EPOCHS} supply, {_sql_weight("domain")} w0, {_sql_weight("lang")} w1, {_sql_weight("source")} w2 from doc where n_tokens > 0 group by all),
    share0 as (select least(sum(supply), floor(sum(tokens) * {MIX_SHARE}::double))::bigint share from leaf),
    {_sql_deal(0)}, {_sql_deal(1)}, {_sql_deal(2)},
    plan as (select leaf.domain, leaf.lang, leaf.source, share // tokens whole, share % tokens rest from leaf join share3 using (domain, lang, source) where share > 0),
    ordered as (select d.*, p.whole, p.rest, coalesce(sum(n_tokens) over (partition by d.domain, d.lang, d.source order by md5('{MIX_SEED}:' || p.whole || ':' || id) || ':' || text_md5 rows between unbounded preceding and 1 preceding), 0)::bigint prior
        from doc d join plan p on d.domain = p.domain and d.lang = p.lang and d.source = p.source where n_tokens > 0)
select doc_id, domain, lang, source, n_tokens, (whole + case when prior < rest then 1 else 0 end)::bigint copies,
    (whole * n_tokens + case when prior < rest then least(n_tokens, rest - prior) else 0 end)::bigint taken_tokens
from ordered where whole > 0 or prior < rest"""

_OP3 = r"""
with doc as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
    win as (select doc_id, unnest(range(1, len(w) - 18)) s, w from doc where len(w) >= 20),
    keyed as (select doc_id, s, array_to_string(w[s:s + 19], ' ') k from win),
    late as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) r from keyed) where r > 1),
    gone as (select distinct doc_id, unnest(range(s, s + 20)) p from late),
    word as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x from doc),
    kept as (select doc_id, string_agg(x, ' ' order by p) t, count(*) n from word anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from doc left join kept using (doc_id)"""


def _sql_tree(text: str) -> str:
    """The sections of a text's tree."""
    pieces = rf"regexp_extract_all(p, '[^.!?]{{1,{fingerprints.PIECE}}}[.!?]*|[.!?]+')"
    line = f"list_transform(string_split({text}, chr(10)), lambda p: coalesce(array_to_string(list_transform({pieces}, lambda x: substr(md5(x), 1, {fingerprints.LEAF})), ''), '') || sha256(p))"
    return f"list_filter(string_split(regexp_replace(array_to_string({line}, ' ') || ' ', '([0-3]) ', '\\1 |', 'g'), '|'), lambda s: s <> '')"


def _sql_near(a: str, b: str) -> str:
    """Dice of all distinct leaves, without going down the tree."""
    return f"case when {a}s = {b}s then 1.0 when len({a}l) + len({b}l) = 0 then 0.0 else 2.0::double * len(list_intersect({a}l, {b}l)) / (len({a}l) + len({b}l)) end::double"


_SQL_PARAGRAPHS = "list_filter(flatten(list_transform({}, lambda s: string_split(s, ' '))), lambda p: p <> '')"
_SQL_LEAVES = "list_distinct(flatten(list_transform({}, lambda p: regexp_extract_all(substr(p, 1, len(p) - 64), '[0-9a-f]{{8}}'))))"
_SQL_LOST = "coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter({0}, lambda x: not list_contains({1}, x)), lambda x: {2}))), ','), '')"
_SQL_ROOT = "sha256(array_to_string(list_transform({0}, lambda s: sha256(s)), ' ')) || ':' || array_to_string({0}, '|')"

_OP4 = f"""
with doc as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n from documents),
    pair as (select doc_id, t, n, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) nx from doc),
    edit as (select *, substr(t, 1, n - n // 4) || substr(nx, 1, n // 4) e from pair),
    tree as (select doc_id, n, sha256(e) edited_sha256, {_sql_tree("t")} ts, {_sql_tree("e")} es, {_sql_tree("nx")} ns from edit),
    para as (select *, {_SQL_PARAGRAPHS.format("ts")} tp, {_SQL_PARAGRAPHS.format("es")} ep, {_SQL_PARAGRAPHS.format("ns")} np from tree),
    leaf as (select *, {_SQL_LEAVES.format("tp")} tl, {_SQL_LEAVES.format("ep")} el, {_SQL_LEAVES.format("np")} nl from para)
select doc_id, n::bigint n_chars, edited_sha256, {_SQL_ROOT.format("ts")} fingerprint, {_SQL_ROOT.format("es")} edited_fingerprint, {_sql_near("t", "e")} near_edited, {_sql_near("t", "n")} near_next,
    {_SQL_LOST.format("ts", "es", "substr(sha256(x), 1, 8)")} edited_sections,
    {_SQL_LOST.format(_SQL_PARAGRAPHS.format("list_filter(ts, lambda x: not list_contains(es, x))"), _SQL_PARAGRAPHS.format("list_filter(es, lambda x: not list_contains(ts, x))"), "substr(x, len(x) - 63, 8)")} edited_paragraphs
from leaf"""


def _sql_licenses() -> str:
    known = {n: license_scan.template_bigrams(t) for n, t in sorted(license_scan.TEMPLATES.items())}
    rows = ", ".join(f"('{n}', [{', '.join(chr(39) + x + chr(39) for x in b)}])" for n, b in known.items())
    return rf"""
with tpl(license, tb) as (values {rows}),
    lines as (select doc_id, text, string_split(text, chr(10)) l from documents where text is not null),
    unit as (select doc_id, unnest(range(len(l)))::bigint line, unnest(l) u from lines union all select doc_id, -1::bigint, text from lines where len(l) > 1),
    word as (select doc_id, line, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), ' ') w from unit),
    gram as (select doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g from word where len(w) > 1),
    scored as (select doc_id, line, license, 2.0::double * len(list_intersect(g, tb)) / (len(g) + len(tb)) d from gram join tpl on len(g) between len(tb) * {license_scan.THRESHOLD} / (2 - {license_scan.THRESHOLD}) - 1 and len(tb) * (2 - {license_scan.THRESHOLD}) / {license_scan.THRESHOLD} + 1),
    best as (select *, row_number() over (partition by doc_id, line order by d desc, license) r from scored where d >= {license_scan.THRESHOLD})
select doc_id, line, license, round(d, 6) dice from best where r = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": _OP1, "op3_substring_dedup": _OP3, "op4_fingerprints": _OP4, "op5_license_scan": _sql_licenses()}
