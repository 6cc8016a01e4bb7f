"""Registered queries of translation, review, reports, client forms and the smaller rules, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from noticeflow.functions import client, glossary, i18n, rules, slots, text
from noticeflow.functions import patterns as P
from noticeflow.operators import cards, corpus, evals, judges, reports, token_budget, translation
from noticeflow.plans import offline
from noticeflow.plans.queries import _AMOUNTS_DUCK, _CAT_DUCK, _DATES_DUCK, _IMP_DUCK, _TIMES_DUCK, GLOSSARY, N_DUCK, ORACLES, R_PHONE, R_URL, _each, notices, query, table
from noticeflow.sources import convert

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _re2(pattern: str) -> str:
    return pattern.removeprefix(P.U).replace(r"\z", "$").replace("'", "''")


_ORDERS = "(select *, 'Clerk#' || lpad((o_custkey * 7 % 1000)::varchar, 9, '0') as o_clerk, 'note ' || o_orderkey as o_comment, 0 as o_shippriority from orders)"


def _orders(spark, sf_dir):
    """Orders with a clerk, a comment and a priority of shipment, which the table does not have."""
    o = table(spark, sf_dir, "orders")
    return o.withColumns({"o_clerk": F.concat(F.lit("Clerk#"), F.lpad((F.col("o_custkey") * 7 % 1000).cast("string"), 9, "0")), "o_comment": F.concat(F.lit("note "), "o_orderkey"), "o_shippriority": F.lit(0)})


# sentences and lines


def _rejected(patterns: list[str]) -> str:
    return "(length(text) < 7 or " + " or ".join(f"regexp_matches(text, '{_re2(p)}')" for p in patterns) + ")"


_SENT_DUCK = f"""s as (select notice_id, {_TRIM.format("unnest(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\s+(\\d+[.)]\\s)', chr(1) || '\\1', 'g'), '\\s+([가-힣]\\.\\s)', chr(1) || '\\1', 'g'), chr(1)))")} as text from n)"""


@query(f"with {N_DUCK}, {_SENT_DUCK} select notice_id, text, {_rejected(P.NOT_TODO)} as rejected, {_rejected(P.NOT_TODO_LEGACY)} as rejected_legacy, length(trim(text)) >= 7 as long_enough from s where length(text) > 3")
def sentence_rejects(spark, sf_dir):
    s = notices(spark, sf_dir).select("notice_id", F.explode(text.sentences(F.col("text"), plain=True, drop_lines=False)).alias("text"))
    return s.select("notice_id", "text", rules.rejected(F.col("text")).alias("rejected"), rules.rejected(F.col("text"), legacy=True).alias("rejected_legacy"), rules.long_enough(F.col("text")).alias("long_enough"))


_LINE_DUCK = "lines as (select notice_id, {0} as text from (select notice_id, unnest(string_split(replace(text, '. ', '.' || chr(10)), chr(10))) as text from n))".format(_TRIM.format("text"))


@query(f"""with {N_DUCK}, {_LINE_DUCK} select notice_id, count(*) filter (where not regexp_matches(text, '{_re2(P.HEADING_LINE)}') and not regexp_matches(text, '{_re2(P.NOISE_LINE)}') and length(text) > 3) as kept,
  count(*) filter (where not regexp_matches(text, '{_re2(P.HEADING_LINE)}') and not regexp_matches(text, '{_re2(P.NOISE_LINE_ANYWHERE)}') and length(text) > 3) as kept_strict from lines group by notice_id""")
def heading_lines(spark, sf_dir):
    """Lines of a notice that are no heading and no link, phone or time; a line per sentence here."""
    n = notices(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n")))
    one = lambda strict: F.size(F.filter(F.split("text", "\n", -1), lambda x: F.size(text.sentences(F.regexp_replace(x, r"[\s.!?]+(?=.)", "_"), plain=True, noise_anywhere=strict)) > 0))
    return n.select("notice_id", one(False).alias("kept"), one(True).alias("kept_strict"))


_FLAT_DUCK = "trim(regexp_replace(replace(coalesce(text, ''), chr(0), ' '), '\\s+', ' ', 'g'))"
_MARKS_DUCK = f"string_split(regexp_replace({_FLAT_DUCK}, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_SIMPLE_DUCK = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
ORACLES["doc_sentence_counts"] = f"""select doc_id, len(list_filter({_MARKS_DUCK}, lambda x: trim(x) <> ''))::int as by_mark, len(list_filter({_SIMPLE_DUCK}, lambda x: length({_TRIM.format('x')}) > 3))::int as simple from documents"""


@query(ORACLES["doc_sentence_counts"])
def doc_sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences_by_mark(F.col("text"))).alias("by_mark"), F.size(text.sentences_simple(F.col("text"))).alias("simple"))


_CHUNK_DUCK = f"""m as (select doc_id, list_transform(list_filter({_MARKS_DUCK}, lambda x: trim(x) <> ''), lambda x: trim(x)) as parts from documents),
  c as (select doc_id, case when len(parts) = 0 then [] else string_split(list_reduce(parts, lambda acc, x: case when length(string_split(acc, chr(1))[-1]) + 1 + length(x) > 384 then acc || chr(1) || x else acc || ' ' || x end), chr(1)) end as chunks from m)"""
ORACLES["greedy_chunks"] = f"with {_CHUNK_DUCK} select doc_id, (generate_subscripts(chunks, 1) - 1)::int as pos, unnest(chunks) as chunk from c"
_WORDS = "len(string_split({}, ' '))"
ORACLES["token_chunks"] = f"""with m as (select doc_id, list_transform(list_filter({_MARKS_DUCK}, lambda x: trim(x) <> ''), lambda x: trim(x)) as parts from documents),
  c as (select doc_id, case when len(parts) = 0 then [] else string_split(list_reduce(parts, lambda acc, x: case when {_WORDS.format('string_split(acc, chr(1))[-1]')} + {_WORDS.format('x')} > 64 then acc || chr(1) || x else acc || ' ' || x end), chr(1)) end as chunks from m),
  e as (select doc_id, (generate_subscripts(chunks, 1) - 1)::int as pos, unnest(chunks) as chunk from c) select doc_id, pos, {_WORDS.format('chunk')}::int as n_tokens, sha256(chunk) as chunk_sha256 from e"""
ORACLES["term_sentences"] = f"""with m as (select doc_id, list_filter(list_transform({_MARKS_DUCK}, lambda x: trim(x)), lambda x: x <> '') as parts from documents),
  e as (select doc_id, unnest(parts) as x, generate_subscripts(parts, 1) as i from m), r as (select *, row_number() over (partition by doc_id order by case when contains(x, 'tion') or contains(x, 'ung') then 0 else 1 end, i) as k from e)
  select d.doc_id, coalesce(string_agg(x, chr(10) order by i), '') as chosen from documents d left join r on d.doc_id = r.doc_id and k <= 5 group by d.doc_id"""
ORACLES["original_fill"] = f"""with {N_DUCK}, p as (select notice_id, generate_subscripts(l, 1) as pos, {_TRIM.format('unnest(l)')} as text from (select notice_id, regexp_split_to_array(text, '[.。\\n]') as l from n where notice_id % 3 <> 0)),
  own as (select notice_id, 0 as pos, text from n where notice_id % 3 = 0),
  c as (select *, {_CAT_DUCK} as cat from (select *, false as labelled from p where length(text) > 8 and not regexp_matches(text, '{_re2(P.GREETING)}') union all select *, true from own)),
  i as (select * from (select *, {_IMP_DUCK} as imp from c) where labelled or imp >= 0.65),
  cats as (select notice_id, string_agg(cat, ', ' order by pos) as category from (select notice_id, cat, min(pos) as pos from i group by notice_id, cat) group by notice_id),
  kws as (select notice_id, string_agg(substr(text, 1, 60), ' / ' order by pos) as keywords from (select *, row_number() over (partition by notice_id order by pos) as k from i where imp >= 0.70) where k <= 5 group by notice_id),
  tops as (select notice_id, max(imp)::varchar as importance from i group by notice_id)
  select n.notice_id as id, n.text as original_text, coalesce(category, '') as category, coalesce(keywords, '') as keywords, coalesce(importance, '') as importance, case when n.notice_id % 3 = 0 then 'labelled' else 'rule' end as origin
  from n left join cats using (notice_id) left join kws using (notice_id) left join tops using (notice_id)"""


@query(f"""select doc_id, sha256({_TRIM.format("regexp_replace(regexp_replace(regexp_replace(text, ' ([가-힣])\\n([가-힣])', ' \\1\\2', 'g'), '([^.!?\\n])\\n([^\\n])', '\\1 \\2', 'g'), '[ \\t]+', ' ', 'g')")}) as joined_sha256,
  sha256({_TRIM.format("regexp_replace(regexp_replace(replace(replace(text, chr(0), ''), chr(13), ''), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) as squeezed_sha256,
  sha256({_TRIM.format("regexp_replace(text, '^[\\s■▶▸◆●○*•-]+', '')")}) as unmarked_sha256 from documents""")
def doc_lines(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.join_broken_lines(t), 256).alias("joined_sha256"), F.sha2(text.clean(t, squeeze=True), 256).alias("squeezed_sha256"), F.sha2(text.strip_markers(t), 256).alias("unmarked_sha256"))


@query(f"with {N_DUCK} select notice_id, text as sentence, case when {_rejected(P.NOT_TODO)} then 0 when exists (select 1 from (select unnest(['도시락, 물통과 돗자리', '학교 안내를 확인', '회비']) as k) where length(k) >= 8 and contains(text, k)) then 1 else 0 end as label from n")
def keyword_labels(spark, sf_dir):
    k = F.array(*map(F.lit, ["도시락, 물통과 돗자리", "학교 안내를 확인", "회비"]))
    return notices(spark, sf_dir).select("notice_id", F.col("text").alias("sentence"), rules.todo_label(F.col("text"), k).alias("label"))


@query(f"with {N_DUCK} select notice_id, regexp_matches(text, '{_re2(P.GREETING)}') as greeting, regexp_matches(text, '{_re2(P.MEAL_PLAN)}') as meal_plan from n")
def greeting_flags(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", rules.is_greeting(F.col("text")).alias("greeting"), rules.is_meal_plan(F.col("text")).alias("meal_plan"))


# glossary, masks, translation


def _masked_duck(source: str) -> str:
    return f"""u as (select *, regexp_extract(src, '{R_URL}', 1) as url from {source}), v as (select *, case when url = '' then src else replace(src, url, '⟦P0⟧') end as t1 from u),
  w as (select *, regexp_extract(t1, '{R_PHONE}', 1) as phone from v), m as (select *, case when phone = '' then t1 else replace(t1, phone, '⟦P' || (url <> '')::int || '⟧') end as masked from w)"""


@query(f"with {N_DUCK}, q as (select notice_id, text as src from n), {_masked_duck('q')} select notice_id, masked, (url <> '')::int + (phone <> '')::int as n_kept from m")
def masked_notices(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", glossary.masked(F.col("text")).alias("m")).select("notice_id", F.col("m.text").alias("masked"), F.size("m.kept").alias("n_kept"))


def _injected_duck(of: str, hits_in: str) -> str:
    out = of
    for k, v in sorted((g for g in GLOSSARY if g[1]), key=lambda g: -len(g[0])):
        out = f"(case when contains({hits_in}, '{k}') then replace({out}, '{k}', '{k}({v})') else {out} end)"
    return out


def _injected_rows(source: str, column: str) -> str:
    """A chain of common tables, one for each term, so that the text of the SQL stays small."""
    chain, last = [], source
    for i, (k, v) in enumerate(sorted((g for g in GLOSSARY if g[1]), key=lambda g: -len(g[0]))):
        x = f"i{i - 1}.injected" if i else f"{last}.{column}"
        chain.append(f"i{i} as (select * {'exclude injected' if i else ''}, case when contains({column}, '{k}') then replace({x}, '{k}', '{k}({v})') else {x} end as injected from {last})")
        last = f"i{i}"
    return ", ".join(chain), last


_CHAIN, _LAST = _injected_rows("m", "masked")


def _stand_in(rows):
    """Stands in for a translator: names the language, puts an amount in a foreign form, fails on some texts."""
    def one(t, code):
        if "1억" in t:
            raise RuntimeError("too long")
        return f"<{code}> {t} 12.345 dollars"
    return [one(t, code) for t, code in rows]


@query(f"""with {N_DUCK}, q as (select notice_id, substr(trim(text), 1, 100) as src from n), {_masked_duck('q')}, {_CHAIN},
  a as (select *, '<vie_Latn> ' || injected || case when regexp_matches(src, '\\d[\\d,]*\\s*원') then ' 12,345 won' else ' 12.345 dollars' end as answer from {_LAST})
  select notice_id, case when contains(injected, '1억') then '' else replace(replace(answer, case when url = '' then chr(1) else '⟦P0⟧' end, url), case when phone = '' then chr(1) else '⟦P' || (url <> '')::int || '⟧' end, phone) end as translated,
  contains(injected, '1억') as failed from a""")
def short_translations(spark, sf_dir):
    out = translation.translate_short(notices(spark, sf_dir).select("notice_id", "text"), "text", "vi", GLOSSARY, _stand_in)
    return out.select("notice_id", "translated", F.col("translated_error").isNotNull().alias("failed"))


@query(ORACLES["token_chunks"])
def token_chunks(spark, sf_dir):
    """Sentences in chunks of at most 64 words."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.sentences_by_mark(F.col("text")).alias("parts"))
    c = token_budget.token_chunks(d, "parts", 64).select("doc_id", F.posexplode("chunks").alias("pos", "c"))
    return c.select("doc_id", "pos", "c.n_tokens", F.sha2("c.text", 256).alias("chunk_sha256"))


@query(f"with {_CHUNK_DUCK} select doc_id, len(chunks) as n_chunks, sha256(array_to_string(list_transform(chunks, lambda x: 'eng_Latn:' || x), chr(10))) as translated_sha256 from c")
def chunk_translations(spark, sf_dir):
    out = translation.translate_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", "en", lambda rows: [f"{code}:{t}" for t, code in rows])
    return out.select("doc_id", "n_chunks", F.sha2("translated", 256).alias("translated_sha256"))


@query()
def reviewed_translations(spark, sf_dir):
    """The one-text form with a translator that gives its input back; its parts have SQL of their own."""
    out = translation.translate_and_review(notices(spark, sf_dir).select("notice_id", "text"), "text", "vi", GLOSSARY, lambda rows: [t for t, _ in rows])
    return out.drop("text")


@query("""select conv_id, turn, case when regexp_matches(text, '\\d[\\d,]*\\s*원') then 1 else 0 end as has_won, 'pay ' || case when turn % 2 = 0 then '1,234 won' else '1.234 dollars' end as fixed from conversations""")
def currency_fixes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    source = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" 500원"))).otherwise(F.lit("nothing"))
    return c.select("conv_id", "turn", F.col("text").rlike(r"\d[\d,]*\s*원").cast("int").alias("has_won"), glossary.currency_fixed(source, F.lit("pay 1.234 dollars")).alias("fixed"))


_WIDE = "g as (select (p_partkey % 50)::int as pos, p_name as korean, case when p_size % 3 = 0 then '' else p_brand end as preferred_vi, case when p_size % 4 = 0 then ' ' else p_type end as preferred_en from part)"


@query(f"with {_WIDE} select korean, 'vi' as lang, preferred_vi as preferred from g where trim(preferred_vi) <> '' union all select korean, 'en', preferred_en from g where trim(preferred_en) <> ''")
def glossary_cells(spark, sf_dir):
    """Cells of a wide glossary by language, those that are filled."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).cast("int").alias("pos"), F.col("p_name").alias("korean"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("preferred_vi"), F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type")).alias("preferred_en"))
    return glossary.unpivot(p, ["vi", "en"]).filter(text.strip(F.coalesce("preferred", F.lit(""))) != "").select("korean", "lang", "preferred")


@query("select p_brand, arg_max(p_name, p_partkey) as p_name from part group by p_brand")
def last_term_wins(spark, sf_dir):
    return corpus.last_of_each(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


# judges and suggestions


def _judge(rows):
    """Stands in for a judge: scores by the number between # marks, in a code fence; some answers are no JSON, some calls fail."""
    def one(prompt):
        k = int(re.search(r"#(\d+)#", prompt)[1])
        if k % 11 == 0:
            raise RuntimeError("busy")
        if k % 10 == 9:
            return "I cannot tell."
        return "```json\n" + json.dumps({"a_score": k % 130, "b_score": f"{k % 90}.5", "before_score": k % 130, "after_score": k % 130, "verdict": "v"}) + "\n```"
    return [one(p) for (p,) in rows]


_KEYED = "o_orderkey % 11 <> 0 and o_orderkey % 10 <> 9"


def _ab(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("notice_id"), F.col("o_clerk").alias("title"), F.concat(F.lit("#"), "o_orderkey", F.lit("#")).alias("a_input"), F.lit("x").alias("a_translation"), F.col("o_orderstatus").alias("b_input"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise("y").alias("b_translation"))
    return judges.judge_ab(o, "English", _judge, retries=1, wait=0.0)


_AB = f"j as (select o_orderkey as notice_id, o_clerk as title, length('#' || o_orderkey || '#')::int as a_chars, length(o_orderstatus)::int as b_chars, least(100, o_orderkey % 130)::int as a_score, round_even(o_orderkey % 90 + 0.5, 0)::int as b_score from {_ORDERS} where {_KEYED} and o_orderkey % 7 <> 0)"


@query(f"with {_AB} select *, 'v' as verdict, '' as a_issues from j")
def ab_judgements(spark, sf_dir):
    return _ab(spark, sf_dir).select("notice_id", "title", "a_chars", "b_chars", "a_score", "b_score", "verdict", "a_issues")


@query(f"with {_AB} select notice_id, case when length(title) > 18 then substr(title, 1, 18) || '...' else title end as title, a_score, b_score, b_score - a_score as delta, case when b_score - a_score > 5 then 'B better' when b_score - a_score < -5 then 'A better' else 'tie' end as verdict from j")
def ab_score_rows(spark, sf_dir):
    return reports.ab_scores(_ab(spark, sf_dir))


@query(f"with {_AB}, m as (select round(avg(a_score), 1) as a, round(avg(b_score), 1) as b from j) select a as mean_a, b as mean_b, round(b - a, 1) as difference from m")
def ab_score_means(spark, sf_dir):
    return reports.ab_means(_ab(spark, sf_dir))


@query(f"select o_orderkey as korean_term, least(100, o_orderkey % 130)::int as before_score, least(95, o_orderkey % 130)::int as after_score from orders where {_KEYED} and o_orderkey % 3 <> 0")
def term_judgements(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("vi").alias("lang"), F.col("o_orderkey").alias("korean_term"), F.concat(F.lit("#"), "o_orderkey", F.lit("#")).alias("sentence"), F.lit("t").alias("nllb_translation"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("p").alias("glossary_preferred"))
    o = o.withColumn("korean_term", F.col("korean_term").cast("string"))
    return judges.judge_terms(o, _judge, retries=1, wait=0.0).select(F.col("korean_term").cast("bigint").alias("korean_term"), "before_score", "after_score")


def _suggest(rows):
    """Stands in for suggestions: a term of many letters has none, others are in capitals."""
    return ["" if len(t) > 32 else t.upper() for t, _ in rows]


_TERMS = "t as (select p_name as korean, case when p_partkey % 2 = 0 then substr(p_name, 1, 6) else p_brand end as preferred, case when length(p_name) > 32 then '' else upper(p_name) end as suggestion from part), s as (select *, lower(trim(preferred)) as p, lower(suggestion) as g from t), r as (select korean, preferred, suggestion, case when suggestion = '' then 'no_response' when p = g or contains(p, g) or contains(g, p) then 'match' else 'mismatch' end as status from s)"


def _reviewed(spark, sf_dir):
    g = table(spark, sf_dir, "part").select(F.col("p_name").alias("korean"), F.when(F.col("p_partkey") % 2 == 0, F.substring("p_name", 1, 6)).otherwise(F.col("p_brand")).alias("preferred"))
    return judges.review_terms(g, judges.suggest_terms(g, "vi", _suggest), "preferred")


@query(f"with {_TERMS} select * from r")
def term_review(spark, sf_dir):
    return _reviewed(spark, sf_dir)


@query(f"with {_TERMS}, k as (select unnest(['match', 'mismatch', 'no_response']) as status), c as (select k.status, count(r.status) as n from k left join r using (status) group by k.status) select status, n, round(n * 100.0 / sum(n) over (), 1) as pct from c")
def term_review_shares(spark, sf_dir):
    return judges.status_shares(_reviewed(spark, sf_dir))


# reports


@query("with c as (select source, count(*) as n, min(doc_id) as f from documents where source <> '' group by source) select row_number() over (order by n desc, f)::int as rank, source, n, n * 100.0 / sum(n) over () as pct from c")
def source_ranks(spark, sf_dir):
    return reports.frequencies(table(spark, sf_dir, "documents"), "source", "doc_id")


def _labelled_rows(spark, sf_dir):
    n = notices(spark, sf_dir)
    return n.select(F.when(F.col("notice_id") % 9 == 0, "").otherwise((F.col("notice_id") % 400).cast("string")).alias("notice_id"), F.when(F.col("notice_id") % 5 != 0, F.col("parent_id")).alias("original_id"), F.col("text").alias("sentence"), (F.col("notice_id") % 3 == 0).alias("is_todo"), rules.category(F.col("text")).alias("category"))


@query(f"""with {N_DUCK}, l as (select *, {_CAT_DUCK} as cat from n), c as (select cat, count(*) as k from l group by cat)
  select count(*) as n, count(distinct case when notice_id % 9 <> 0 then notice_id % 400 end) as n_notices, count(*) filter (where notice_id % 5 = 0) as n_without_original, count(*) filter (where notice_id % 3 = 0) as n_todo,
  count(*) filter (where notice_id % 3 <> 0) as n_other, (select max(k) / min(k) from c) as imbalance from l""")
def labelled_summary(spark, sf_dir):
    return reports.labelled_summary(_labelled_rows(spark, sf_dir))


_MODELS = "p as (select 'toxic' as model, quality, toxic as pred from labels union all select 'length', quality, (n_chars > 600)::int from labels join documents using (doc_id))"
_MSCORES = f"""{_MODELS}, k as (select model, x as label, count(*) filter (where quality = x and pred = x) as tp, count(*) filter (where pred = x) as pp, count(*) filter (where quality = x) as support from p, (select unnest([0, 1]) as x) group by model, x),
  f as (select model, label, case when pp = 0 then 0 else tp / pp end as p, case when support = 0 then 0 else tp / support end as r, support from k), e as (select *, case when p + r = 0 then 0 else p * r * 2 / (p + r) end as f1 from f)"""


def _predictions(spark, sf_dir):
    lab, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.select(F.lit("toxic").alias("model"), "quality", F.col("toxic").cast("int").alias("pred")).unionByName(lab.join(d, "doc_id").select(F.lit("length").alias("model"), "quality", (F.col("n_chars") > 600).cast("int").alias("pred")))


@query(f'with {_MSCORES} select model, label, round(p, 4) as "precision", round(r, 4) as recall, round(f1, 4) as f1, support from e')
def model_scores(spark, sf_dir):
    return reports.model_scores(_predictions(spark, sf_dir), "quality", "pred", [0, 1])


@query(f"""with {_MSCORES}, m as (select model, round(avg(p), 4) as macro_precision, round(avg(r), 4) as macro_recall, round(avg(f1), 4) as macro_f1 from e group by model)
  select model, macro_precision, macro_recall, macro_f1, round(macro_f1 - (select macro_f1 from m where model = 'toxic'), 4) as delta, case when model <> 'toxic' then case when macro_f1 - (select macro_f1 from m where model = 'toxic') >= 0.05 then 'adopt' else 'keep' end end as decision from m""")
def model_comparison(spark, sf_dir):
    return reports.compare_models(_predictions(spark, sf_dir), "quality", "pred", [0, 1], "toxic")


_COSTS = """r as (select o_orderkey, round((1 - (o_orderkey % 40) / 40.0) * 100, 1) as input_reduction_pct, case when o_orderkey % 5 = 0 then 0 else round((1 + o_custkey % 8) / (o_orderkey % 5 * 0.5), 2) end as speedup_x from orders)"""


def _costs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(40).alias("a_chars"), (F.col("o_orderkey") % 40).alias("b_chars"), (1.0 + F.col("o_custkey") % 8).alias("a_time"), (F.col("o_orderkey") % 5 * 0.5).alias("b_time"))
    return reports.run_costs(o)


@query(f"with {_COSTS} select * from r")
def run_costs(spark, sf_dir):
    return _costs(spark, sf_dir).select("o_orderkey", F.col("input_reduction_pct").cast("double").alias("input_reduction_pct"), F.col("speedup_x").cast("double").alias("speedup_x"))


@query(f"with {_COSTS} select count(*) as n, round(avg(input_reduction_pct), 1) as mean_reduction_pct, round(avg(speedup_x), 2) as mean_speedup_x from r")
def mean_costs(spark, sf_dir):
    return reports.mean_costs(_costs(spark, sf_dir))


@query("""with g as (select lang, count(*) filter (where source <> '') as n_terms, count(*) filter (where source <> '' and contains(text, 'the')) as n_reflected from documents group by lang union all
  select '전체', count(*) filter (where source <> ''), count(*) filter (where source <> '' and contains(text, 'the')) from documents) select lang, n_terms, n_reflected, case when n_terms > 0 then n_reflected * 100.0 / n_terms end as rate, coalesce(format('{:.1f}%', n_reflected * 100.0 / n_terms), '—') as shown from g""")
def reflection_report(spark, sf_dir):
    return reports.reflection_report(table(spark, sf_dir, "documents"), "lang", "source", F.col("text").contains("the"))


# client forms


def _card_rows(spark, sf_dir):
    o = _orders(spark, sf_dir).select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("header_ko"), F.when(F.col("o_orderkey") % 7 == 0, "null").otherwise("H").alias("header_translated"), F.when(F.col("o_orderkey") % 6 == 0, " ").otherwise(F.col("o_clerk")).alias("value_ko"),
        F.when(F.col("o_orderkey") % 2 == 0, "easy").alias("value_easy_ko"), F.lit("").alias("value_translated"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("chip"), ((F.col("o_orderkey") % 20) / 20).alias("importance"),
    )
    fields = [x.split(":")[0] for x in cards.CARD[len("struct<") : -1].split(",")]
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", F.struct(*fields).alias("card"))))
    return o.groupBy("o_custkey").agg(F.transform(ordered, lambda x: x["card"]).alias("cards"))


_CARDS = f"""k as (select o_custkey, o_orderkey, case when o_orderkey % 5 = 0 then '' else trim(o_orderpriority) end as h, case when o_orderkey % 7 = 0 then '' else 'H' end as ht, case when o_orderkey % 6 = 0 then '' else trim(o_clerk) end as v,
  case when o_orderkey % 2 = 0 then 'easy' else '' end as ve, case when o_orderkey % 3 = 0 then o_orderstatus else '' end as chip, (o_orderkey % 20) / 20 as importance from {_ORDERS})"""


def _line_duck(h: str, v: str) -> str:
    return f"case when {v} <> '' then case when chip <> '' then '[' || chip || '] ' else '' end || case when {h} <> '' then {h} || ': ' else '' end || {v} || chr(10) end"


@query(f"""with {_CARDS} select o_custkey, coalesce(string_agg({_line_duck('h', 'v')}, '' order by o_orderkey), '') as ko, coalesce(string_agg({_line_duck('h', "coalesce(nullif(ve, ''), v)")}, '' order by o_orderkey), '') as easy,
  coalesce(string_agg({_line_duck("coalesce(nullif(ht, ''), h)", 'v')}, '' order by o_orderkey), '') as translated from k group by o_custkey""")
def client_card_lines(spark, sf_dir):
    return _card_rows(spark, sf_dir).select("o_custkey", client.card_lines(F.col("cards")).alias("l")).select("o_custkey", "l.*")


@query(f"""with {_CARDS}, s as (select *, row_number() over (partition by o_custkey order by o_orderkey) as i from k where h <> '' or v <> '')
  select o_custkey, (i - 1)::int as pos, chip, case when h = '' then v else h || ' · ' || v end as label from s where i <= 8""")
def client_chips(spark, sf_dir):
    return _card_rows(spark, sf_dir).select("o_custkey", F.posexplode(client.chips(F.col("cards"))).alias("pos", "c")).select("o_custkey", "pos", "c.*")


@query(f"with {_CARDS}, s as (select *, row_number() over (partition by o_custkey order by importance desc, o_orderkey) as i from k) select o_custkey, (i - 1)::int as pos, importance, case when o_orderkey % 6 = 0 then ' ' else o_clerk end as value_ko from s join {_ORDERS} using (o_custkey, o_orderkey) where i <= 8")
def ranked_cards(spark, sf_dir):
    """The eight most important cards, equals as they stand."""
    r = _card_rows(spark, sf_dir).select("o_custkey", F.posexplode(cards.ranked(F.col("cards"))).alias("pos", "c"))
    return r.select("o_custkey", "pos", "c.importance", "c.value_ko")


@query(f"""with c as (select o_custkey, o_orderkey, o_orderpriority as h, substr(o_clerk, 1, (8 + o_orderkey % 8)::int) as v from {_ORDERS}),
  g as (select a.o_custkey, a.o_orderkey from c a join c b on a.o_custkey = b.o_custkey and a.h = b.h and contains(b.v, a.v) and (length(b.v) > length(a.v) or (length(b.v) = length(a.v) and b.o_orderkey < a.o_orderkey)))
  select o_custkey, h as header_ko, v as value_ko from c anti join g using (o_custkey, o_orderkey)""")
def deduped_cards(spark, sf_dir):
    """Values that a longer value of the same header contains are left out."""
    o = _orders(spark, sf_dir).withColumns({"header_ko": F.col("o_orderpriority"), "value_ko": F.substring("o_clerk", F.lit(1), (8 + F.col("o_orderkey") % 8).cast("int")), "importance": F.lit(0.5)})
    none = {c: F.lit("") for c in ("header_translated", "value_easy_ko", "value_translated", "chip")}
    fields = [x.split(":")[0] for x in cards.CARD[len("struct<") : -1].split(",")]
    g = o.withColumns(none).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.struct(*fields).alias("card")))), lambda x: x["card"]).alias("cards"))
    return g.select("o_custkey", F.explode(cards.dedup(F.col("cards"))).alias("c")).select("o_custkey", "c.header_ko", "c.value_ko")


_LANGS9 = "['vi','en','zh','ja','th','ms','mn','ru','ko_easy','xx']"


@query(f"""select lang, case lang when 'en' then coalesce(nullif(r.r_name, ''), '') when 'vi' then 'v' else '' end || n as shown, {"case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in P.VOICES.items()) + " else '' end"} as voice,
  {"case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in P.NLLB_CODES.items()) + " else 'vie_Latn' end"} as code from (select unnest({_LANGS9}) as lang), (select trim(r_name) as r_name, '' as n from region) r""")
def client_languages(spark, sf_dir):
    """Per language the text that a response has for it, its voice and its translator's code."""
    r = table(spark, sf_dir, "region").select(F.lit("NULL").alias("en_text"), F.col("r_name").alias("english"), F.lit(" ").alias("corrected_vi_text"), F.lit("v").alias("vietnamese")).withColumn("lang", F.explode(F.array(*map(F.lit, [*P.LANGUAGES, "xx"]))))
    lang = F.col("lang")
    return r.select("lang", client.text_of_language(lang, r.columns).alias("shown"), i18n.voice(lang).alias("voice"), i18n.nllb_code(lang).alias("code"))


@query("""with w as (select doc_id, text, unnest(['the', 'tion']) as word from documents), p as (select doc_id, word, unnest(string_split(text, word)) as part, generate_subscripts(string_split(text, word), 1) as i, len(string_split(text, word)) as n from w),
  s as (select *, sum(length(part)) over (partition by doc_id, word order by i) + (i - 1) * length(word) as start from p) select doc_id, start::int as "start", (start + length(word))::int as "end" from s where i < n""")
def highlighted_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.inline(client.highlights(F.col("text"), F.lit("a->the; b->x; c; d-> tion "))))


@query(f"""select o_orderkey, case when o_orderkey % 4 <> 0 then case when o_orderkey % 3 = 0 then '[' || o_orderstatus || '] ' else '' end || trim(o_clerk) || case when o_orderkey % 5 = 0 then '' else ' · ' || o_shippriority || '원' end || case when o_orderkey % 2 = 0 then ' · ' || trim(o_orderpriority) else '' end end as line from {_ORDERS}""")
def client_item_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    return _orders(spark, sf_dir).select("o_orderkey", client.item_line(F.when(k % 4 != 0, F.col("o_clerk")), F.when(k % 3 == 0, F.col("o_orderstatus")), F.when(k % 5 == 0, "null").otherwise(F.concat("o_shippriority", F.lit("원"))), F.when(k % 2 == 0, F.col("o_orderpriority"))).alias("line"))


@query(f"""with i as (select o_custkey, o_orderkey, case when o_orderkey % 4 = 0 then '' else o_clerk end as title, case when o_orderkey % 3 = 0 then null else (o_orderkey % 10) / 10 end as imp, o_orderkey % 2 = 0 as paid from {_ORDERS})
  select c_custkey as o_custkey, coalesce((select string_agg(title || '. ' || 'S, hat' || case when paid then '. 1 won' else '. 2원' end, chr(10) order by coalesce(imp, 0.5) desc, o_orderkey) from i where i.o_custkey = c.c_custkey and title <> ''), '') as spoken
  from customer c where c_custkey in (select o_custkey from {_ORDERS})""")
def spoken_item_lines(spark, sf_dir):
    """The older speech text of a customer's orders as items."""
    k = F.col("o_orderkey")
    item = F.struct(
        F.lit("").alias("title_ko"), F.when(k % 4 == 0, "").otherwise(F.col("o_clerk")).alias("title_translated"), F.when(k % 3 != 0, (k % 10) / 10).alias("importance"), F.lit(None).cast("string").alias("when"),
        F.array(F.lit("shoe"), F.lit("hat")).alias("what"), F.when(k % 2 == 0, "1원").otherwise("2원").alias("amount"), F.lit(None).cast("string").alias("deadline"),
    )
    entry = lambda ko, t: F.array(F.struct(F.lit(ko).alias("ko"), F.lit(t).alias("translated")))
    summary = F.struct(entry("shoe", "S").alias("supplies"), entry("1원", "1 won").alias("amounts"), entry("x", "").alias("deadlines"))
    g = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))), lambda x: x["item"]).alias("items"))
    return g.select("o_custkey", client.spoken_items(F.col("items"), summary, "vi").alias("spoken"))


# slots as rows, to-do forms, sending, pages


@query(f"""with {N_DUCK}, {_DATES_DUCK}, {_TIMES_DUCK}, {_AMOUNTS_DUCK} select notice_id, 'dates' as slot, ko from d union all select notice_id, 'times', ko from t union all select notice_id, 'amounts', ko from a
  union all select distinct notice_id, 'urls', rtrim(ko, '.,)]') from ({_each(R_URL, 1)}) union all select notice_id, 'phones', ko from ({_each(R_PHONE, 1)})""")
def slot_rows(spark, sf_dir):
    return cards.slot_rows(notices(spark, sf_dir), "notice_id").select("notice_id", "slot", "ko")


@query(f"""select o_orderkey, trim(o_clerk) as text, case when o_orderkey % 2 = 0 then '내일' end as due_date, case when o_orderkey % 3 = 0 then 12000 end::bigint as amount, case when o_orderkey % 5 = 0 then 0.5 else (o_orderkey % 10) / 10 end as confidence,
  coalesce(case when o_orderkey % 5 = 0 then 0.5 else (o_orderkey % 10) / 10 end >= 0.5, false) as is_todo from {_ORDERS}""")
def adapted_todos(spark, sf_dir):
    k = F.col("o_orderkey")
    v1 = _orders(spark, sf_dir).select("o_orderkey", F.concat(F.trim("o_clerk"), F.when(k % 3 == 0, " 12,000원").otherwise("")).alias("text_ko"), F.when(k % 2 == 0, "내일").alias("due_date"), F.when(k % 5 != 0, (k % 10) / 10).alias("importance"))
    out = cards.from_first_form(v1)
    return out.select("o_orderkey", F.regexp_replace("text", " 12,000원$", "").alias("text"), "due_date", "amount", "confidence", rules.is_todo(F.col("confidence")).alias("is_todo"))


@query(f"""select lang, case lang when 'en' then 0 when 'fr' then 1 end as label_id, n % 7 as id, coalesce([{", ".join(f"'{c}'" for c in P.CATEGORIES)}][n % 7 + 1], '기타') as category from (select lang, count(*)::int as n from documents group by lang)""")
def label_ids(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).cast("int").alias("n"))
    label = F.when(F.col("lang") == "en", "LABEL_0").when(F.col("lang") == "fr", "할 일").otherwise("none")
    return g.select("lang", rules.todo_label_id(label).alias("label_id"), (F.col("n") % 7).alias("id"), rules.category_of_id(F.col("n") % 7).alias("category"))


_SEND = f"""u as (select c_custkey as id, case when c_custkey % 3 = 0 then 'teacher' else 'parent' end as role from customer), r as (select o_orderkey, o_custkey as sender, case when o_orderkey % 10 = 0 then o_custkey + 1 else o_custkey end as teacher, o_orderkey % 200 as parent, case when o_orderkey % 8 = 0 then ' ' else o_comment end as text from {_ORDERS}),
  j as (select r.*, s.role as sr, p.role as pr from r left join u s on s.id = sender left join u p on p.id = parent)"""


def _sent(spark, sf_dir):
    k = F.col("o_orderkey")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, "teacher").otherwise("parent").alias("role"))
    r = _orders(spark, sf_dir).select("o_orderkey", F.col("o_custkey").alias("sender_id"), F.when(k % 10 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("teacher_id"), (k % 200).alias("parent_id"), F.when(k % 8 == 0, " ").otherwise(F.col("o_comment")).alias("text"))
    return convert.send(r, users)


@query(f"with {_SEND} select teacher as teacher_id, parent as parent_id, text, length(text)::int as char_count from j where sr = 'teacher' and sender = teacher and pr = 'parent' and trim(text) <> ''")
def sent_notices(spark, sf_dir):
    return _sent(spark, sf_dir)[0].select("teacher_id", "parent_id", "text", "char_count")


@query(f"with {_SEND} select o_orderkey, case when coalesce(sr, '') <> 'teacher' or sender <> teacher then 403 when coalesce(pr, '') <> 'parent' then 404 else 400 end as status from j where not coalesce(sr = 'teacher' and sender = teacher and pr = 'parent' and trim(text) <> '', false)")
def refused_notices(spark, sf_dir):
    return _sent(spark, sf_dir)[1].select("o_orderkey", "status")


@query(f"""with c as (select o_custkey as name, o_orderkey % 3 as page, o_orderkey as pos, substr(o_clerk, 15, 1) as text, (o_orderkey % 100)::double as x, (o_orderkey % 37)::double as y from {_ORDERS})
  select name, page, string_agg(text, '' order by pos) as body from c where not (x + 1 between 10 and 40 and y + 1 between 5 and 20 and page = 1) group by name, page""")
def page_bodies(spark, sf_dir):
    """Characters outside of the boxes of tables, in order."""
    k = F.col("o_orderkey")
    x, y = (k % 100).cast("double"), (k % 37).cast("double")
    c = _orders(spark, sf_dir).select(F.col("o_custkey").alias("name"), (k % 3).alias("page"), k.alias("pos"), F.substring("o_clerk", 15, 1).alias("text"), x.alias("x0"), (x + 2).alias("x1"), y.alias("top"), (y + 2).alias("bottom"))
    boxes = c.filter("page = 1").select("name", "page").distinct().select("name", "page", F.lit(10.0).alias("x0"), F.lit(40.0).alias("x1"), F.lit(5.0).alias("top"), F.lit(20.0).alias("bottom"))
    return convert.page_bodies(c, boxes)


@query("select page_id, length(html)::int as n_one, length(url)::int as n_other, abs(length(html) - length(url))::int as difference from pages")
def extractor_comparison(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    out = convert.compare_texts(p.select(F.col("page_id").alias("name"), F.col("html").alias("text")), p.select(F.col("page_id").alias("name"), F.col("url").alias("text")))
    return out.select(F.col("name").alias("page_id"), "n_one", "n_other", "difference")
