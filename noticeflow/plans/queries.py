"""Registered queries over whole tables, and the SQL that gives the same rows.

The tables hold no Korean text, so notices are made of orders, of six sentence
patterns by the order's number. The SQL answers by the rules (patterns, word
lists), not by the pattern a notice was made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.functions import easy, glossary, i18n, rules, slots, text
from noticeflow.functions import patterns as P
from noticeflow.operators import cards, corpus, evals, judges, terms
from noticeflow.plans import graph, offline
from noticeflow.sources import files
from noticeflow.streaming import inbox

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ACTION = "case substr(o_orderpriority, 1, 1) when '1' then '납부' when '2' then '제출' when '3' then '신청' when '4' then '준비' else '확인' end"
_DAY = "cast(day(o_orderdate) as {s})"
_MONTH = "cast(month(o_orderdate) as {s})"
_NOTICE = f"""select o_orderkey as notice_id, o_custkey as parent_id, case o_orderkey % 6
  when 0 then concat('준비물: 도시락, 물통과 돗자리 ', {{action}}, '해 주세요. 오후 ', cast(1 + o_orderkey % 11 as {{s}}), '시 30분 https://school', cast(o_custkey % 7 as {{s}}), '.example/form')
  when 1 then concat(cast(year(o_orderdate) as {{s}}), '년 ', {_MONTH}, '월 ', {_DAY}, '일까지 참가비 ', {{amount}}, '원을 ', {{action}}, '해 주세요. 문의 02-', lpad(cast(o_custkey % 10000 as {{s}}), 4, '0'), '-', lpad(cast(o_orderkey % 10000 as {{s}}), 4, '0'))
  when 2 then concat('안녕하세요. 학부모님께 안내드립니다. ', {_MONTH}, '.', {_DAY}, '.(금) 14:05에 www.school.example/a', cast(o_custkey % 5 as {{s}}), ' 에서 ', {{action}}, '하세요. 회비 ', cast(1 + o_custkey % 9 as {{s}}), '만 원, 교재 2천원입니다. 전화 1588-', lpad(cast(o_custkey % 10000 as {{s}}), 4, '0'))
  when 3 then concat('다음 주 월요일까지 ', {{action}}, '하시고 내일 오전 9시에 오세요. 총 1억원 중 ', {{amount}}, '원입니다. 031-123-', lpad(cast(o_orderkey % 10000 as {{s}}), 4, '0'))
  when 4 then concat({_MONTH}, '월 ', {_DAY}, '일(화) 오전 10시 15분에 학교 안내를 확인하세요. 신청 https://s.example/f', cast(o_custkey % 3 as {{s}}), '.html 까지 ', {{action}}, '해 주시기 바랍니다. ', {_MONTH}, '월 ', {_DAY}, '일(화) 9:30 시작')
  else concat('문의처: 123-', lpad(cast(o_custkey % 10000 as {{s}}), 4, '0'), ' 회비 ', cast(1000 + o_custkey % 9 as {{s}}), '원을 ', {_MONTH}, '/', {_DAY}, '까지 꼭 ', {{action}}, '해 주세요. 색종이와 풀을 챙겨 주세요') end as text from """
N_SPARK = _NOTICE.format(s="string", amount="format_number(cast(floor(o_totalprice) as bigint), 0)", action=_ACTION) + "{orders}"
N_DUCK = "n as (" + _NOTICE.format(s="varchar", amount="format('{:,}', cast(floor(o_totalprice) as bigint))", action=_ACTION) + "orders)"


def notices(spark, sf_dir: str):
    return spark.sql(N_SPARK, orders=table(spark, sf_dir, "orders"))


def spread_notices(spark, sf_dir: str):
    """Notices dealt out by id: their analysis takes far longer than moving them, and it groups and
    joins by the id, so that this is its one shuffle. Adaptive execution sets the number of partitions."""
    return notices(spark, sf_dir).repartition("notice_id")


GLOSSARY = [("참가비", "phí tham gia"), ("도시락", "cơm hộp"), ("돗자리", "chiếu"), ("비용", "chi phí"), ("연락처", "liên hệ"), ("시간", "giờ"), ("일시", "ngày giờ"), ("참가", "tham gia"), ("물통", "")]
TERMS = [("the", "le"), ("and", "et"), ("that", "que"), ("tion", "ción"), ("ung", "ing"), ("zzz", "none"), ("heit", "")]
_TERMS_DUCK = "terms(pos, korean, preferred) as (values " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(TERMS)) + ")"


# slots of notices


# The rules in the regex syntax of the other engine, which has no look-around: what stands around a match is matched too.
R_FULL = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일(?:\s*\(([월화수목금토일])\))?"
R_MONTH_DAY = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일(?:\s*\(([월화수목금토일])\))?"
R_DOTTED = r"(?:(\d{4})\s*\.\s*)?(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*\(([월화수목금토일])\)"
R_HALF = r"(오전|오후)\s*(\d{1,2})\s*시(?:\s*(\d{1,2})\s*분)?"
R_24H = r"(?:^|[^0-9])([0-9]{1,2}:[0-9]{2})(?:[^0-9]|$)"
R_WON = r"(\d{1,3}(?:,\d{3})+|\d+)\s*원"
R_UNIT = r"(\d+)\s*(만|천|억)\s*원"
R_PHONE = r"(?:^|[^0-9-])(\d{2,4}-\d{3,4}-\d{4}|\d{4}-\d{4}|\d{3,4}-\d{4})(?:[^0-9]|$)"
R_URL = r"""((?:https?://|www\.)[^\s<>"''()]+)"""
R_SLASH = r"(?:^|[^0-9.원시])(\d{1,2})[./](\d{1,2})(?:[^0-9]|$)"
R_SEGMENT = r"[^.\n❍❏|※]*까지[^.\n❍❏|※]*"


def _each(pattern: str, group: int = 0) -> str:
    """Rows (notice_id, ko) of the different matches of a pattern."""
    return f"select distinct notice_id, unnest(regexp_extract_all(text, '{pattern}', {group})) as ko from n"


def _part(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(ko, '{pattern}', {group}), '')"


_DATES_DUCK = f"""rest as (select notice_id, regexp_replace(text, '{R_FULL}', '#', 'g') as text from n), d as (
  select notice_id, ko, {_part(R_FULL, 1)}::int as year, {_part(R_FULL, 2)}::int as month, {_part(R_FULL, 3)}::int as day, {_part(R_FULL, 4)} as weekday, null as relative from ({_each(R_FULL)})
  union all select notice_id, ko, null, {_part(R_MONTH_DAY, 1)}::int, {_part(R_MONTH_DAY, 2)}::int, {_part(R_MONTH_DAY, 3)}, null from ({_each(R_MONTH_DAY).replace("from n", "from rest")})
  union all select notice_id, ko, {_part(R_DOTTED, 1)}::int, {_part(R_DOTTED, 2)}::int, {_part(R_DOTTED, 3)}::int, {_part(R_DOTTED, 4)}, null from ({_each(R_DOTTED)})
  union all select notice_id, w, null, null, null, null, w from n, (select unnest(['내일', '모레', '오늘', '다음 주', '다음주', '이번 주', '이번주']) as w) where contains(text, w))"""
_TIMES_DUCK = f"""t as (select notice_id, ko, {_part(R_HALF, 2)}::int as hour, coalesce({_part(R_HALF, 3)}::int, 0) as minute, {_part(R_HALF, 1)} as ampm from ({_each(R_HALF)})
  union all select notice_id, ko, string_split(ko, ':')[1]::int, string_split(ko, ':')[2]::int, null from ({_each(R_24H, 1)}))"""
_AMOUNTS_DUCK = f"""a as (select notice_id, ko, replace({_part(R_WON, 1)}, ',', '')::bigint as value from ({_each(R_WON)})
  union all select notice_id, ko, {_part(R_UNIT, 1)}::bigint * case {_part(R_UNIT, 2)} when '천' then 1000 when '만' then 10000 else 100000000 end from ({_each(R_UNIT)}) where not regexp_full_match(ko, '{R_WON}'))"""


@query(f"with {N_DUCK}, {_DATES_DUCK} select * from d")
def notice_dates(spark, sf_dir):
    n = notices(spark, sf_dir).select("notice_id", F.explode(slots.dates(F.col("text"))).alias("d"))
    return n.select("notice_id", "d.ko", "d.year", "d.month", "d.day", "d.weekday", "d.relative")


@query(f"with {N_DUCK}, {_TIMES_DUCK} select * from t")
def notice_times(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", F.inline(slots.times(F.col("text"))))


@query(f"with {N_DUCK}, {_AMOUNTS_DUCK} select notice_id, ko, value as amount from a")
def notice_amounts(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", F.explode(slots.amounts(F.col("text"))).alias("a")).select("notice_id", "a.ko", F.col("a.value").alias("amount"))


@query(f"with {N_DUCK} select notice_id, ko as phone from ({_each(R_PHONE, 1)})")
def notice_phones(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", F.explode(slots.phones(F.col("text"))).alias("phone"))


@query(f"with {N_DUCK} select distinct notice_id, rtrim(ko, '.,)]') as url from ({_each(R_URL, 1)})")
def notice_urls(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", F.explode(slots.urls(F.col("text"))).alias("url"))


_ACTION_DUCK = "case " + " ".join(f"when regexp_matches(text, '{p}') then '{h}'" for p, h in P.ACTIONS) + " end"


@query(f"with {N_DUCK} select notice_id, {_ACTION_DUCK} as action from n")
def notice_action(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", slots.action(F.col("text")).alias("action"))


_PAIR_DUCK = "'2026-' || lpad(regexp_extract(text, '{p}', 1), 2, '0') || '-' || lpad(regexp_extract(text, '{p}', 2), 2, '0')"
_DUE_DUCK = (
    f"case when regexp_matches(text, '{R_MONTH_DAY}') then {_PAIR_DUCK.format(p=R_MONTH_DAY.replace('{', '{').replace('}', '}'))} when regexp_matches(text, '{R_SLASH}') then {_PAIR_DUCK.format(p=R_SLASH)}"
    r" else coalesce(nullif(regexp_extract(text, '(?:(?:다음|이번)\s*주|매주)\s*[월화수목금토일]요일|오늘|내일|모레'), ''), case when length(u) between 1 and 19 then u end) end"
)


@query(f"with {N_DUCK} select notice_id, {_DUE_DUCK} as due_date from (select *, trim(regexp_extract(text, '([\\p{{L}}\\p{{N}}_\\s]+?)\\s*까지', 1)) as u from n)")
def due_date_as_of(spark, sf_dir):
    """A text has dates of one kind only, so that the SQL need not ask which of them comes first."""
    return notices(spark, sf_dir).select("notice_id", slots.due_date(F.col("text"), 2026).alias("due_date"))


@query(f"""with {N_DUCK}, u as (select notice_id, text, regexp_extract(text, '{R_URL}', 1) as url from n),
  m as (select notice_id, case when url = '' then text else replace(text, url, '⟦U' || repeat('_', length(url) - 3) || '⟧') end as text from u)
  select notice_id, trim(unnest(regexp_extract_all(text, '{R_SEGMENT}'))) as deadline from m""")
def deadline_phrases(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", F.explode(slots.deadline_phrases(F.col("text"))).alias("deadline"))


@query(f"""with {N_DUCK}, u as (select notice_id, text, regexp_extract(text, '{R_URL}', 1) as url from n),
  m as (select notice_id, text, case when url = '' then text else replace(text, url, '⟦U' || repeat('_', length(url) - 3) || '⟧') end as masked from u)
  select notice_id, coalesce(nullif(regexp_extract(text, '{R_WON}'), ''), nullif(regexp_extract(text, '{R_UNIT}'), '')) as amount, trim(regexp_extract_all(masked, '{R_SEGMENT}')[1]) as deadline from m""")
def notice_firsts(spark, sf_dir):
    """The first amount and the first deadline of each notice, as they are written."""
    t = F.col("text")
    return notices(spark, sf_dir).select("notice_id", slots.first_amount(t).alias("amount"), slots.first_deadline(t).alias("deadline"))


@query(f"""with {N_DUCK}, b as (select notice_id, regexp_replace(regexp_replace(text, '준비물\\s*[:：]?\\s*', '', 'g'), '(을|를)?\\s*(준비해|챙겨|가져)[^\\n]*$', '') as text from n),
  i as (select notice_id, trim(unnest(regexp_split_to_array(text, '[,，、]\\s*|\\s*(?:과|와|및)\\s+'))) as item from b) select notice_id, item from i where length(item) between 2 and 29""")
def supply_tokens(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", F.explode(slots.supplies(F.col("text"))).alias("item"))


_LANG = "(select unnest(['vi','en','zh','ja','th','ms','mn','ru','ko_easy']) as lang)"
_SUFFIX = "case lang when 'ru' then ' вон' when 'mn' then ' вон' when 'th' then ' วอน' when 'zh' then '韩元' when 'ja' then 'ウォン' when 'ko_easy' then '원' else ' won' end"


@query(f"with {N_DUCK}, {_AMOUNTS_DUCK} select notice_id, lang, format('{{:,}}', value) || {_SUFFIX} as shown from a, {_LANG}")
def amount_i18n(spark, sf_dir):
    n = notices(spark, sf_dir).select("notice_id", F.explode(slots.amounts(F.col("text"))).alias("a")).withColumn("lang", F.explode(F.array(*map(F.lit, P.LANGUAGES))))
    return n.select("notice_id", "lang", i18n.format_amount(F.col("a.value"), F.col("lang")).alias("shown"))


def _map_duck(table: dict, key: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


_DAY_MONTH = "day || '/' || month || coalesce('/' || year, '')"
_WEEKDAY = {k: f"coalesce(' (' || {_map_duck(P.WEEKDAYS[k], 'weekday')} || ')', '')" for k in P.WEEKDAYS}


@query(f"""with {N_DUCK}, {_DATES_DUCK} select notice_id, lang, case when relative is not null then
    case lang when 'vi' then coalesce({_map_duck(P.RELATIVE['vi'], 'relative')}, ko) when 'en' then coalesce({_map_duck(P.RELATIVE['en'], 'relative')}, ko) else ko end
    else case lang when 'vi' then 'Ngày ' || {_DAY_MONTH} || {_WEEKDAY['vi']}
    when 'en' then ['January','February','March','April','May','June','July','August','September','October','November','December'][month] || ' ' || day || coalesce(', ' || year, '') || {_WEEKDAY['en']}
    when 'zh' then month || '月' || day || '日' || coalesce(' (' || weekday || ')', '') when 'ja' then month || '月' || day || '日' || coalesce(' (' || weekday || ')', '')
    when 'ko_easy' then ko else {_DAY_MONTH} end end as shown from d, {_LANG}""")
def date_i18n(spark, sf_dir):
    n = notices(spark, sf_dir).select("notice_id", F.explode(slots.dates(F.col("text"))).alias("d")).withColumn("lang", F.explode(F.array(*map(F.lit, P.LANGUAGES))))
    return n.select("notice_id", "lang", i18n.format_date(F.col("d"), F.col("lang")).alias("shown"))


_HALVES = {"vi": (" sáng", " chiều"), "en": (" AM", " PM"), "zh": ("上午", "下午"), "ja": ("午前", "午後")}
_HALF = {k: f"case ampm when '오전' then '{a}' when '오후' then '{b}' else '' end" for k, (a, b) in _HALVES.items()}
_TWO = "lpad(minute::varchar, 2, '0')"


@query(f"""with {N_DUCK}, {_TIMES_DUCK} select notice_id, lang, case lang when 'vi' then hour || ' giờ' || case when minute <> 0 then ' ' || minute else '' end || {_HALF['vi']}
  when 'en' then hour || ':' || {_TWO} || {_HALF['en']} when 'zh' then {_HALF['zh']} || hour || '时' || {_TWO} || '分' when 'ja' then {_HALF['ja']} || hour || '時' || {_TWO} || '分'
  when 'ko_easy' then ko else hour || ':' || {_TWO} end as shown from t, {_LANG}""")
def time_i18n(spark, sf_dir):
    n = notices(spark, sf_dir).select("notice_id", F.explode(slots.times(F.col("text"))).alias("t")).withColumn("lang", F.explode(F.array(*map(F.lit, P.LANGUAGES))))
    return n.select("notice_id", "lang", i18n.format_time(F.col("t"), F.col("lang")).alias("shown"))


def _any(words) -> str:
    return "(" + " or ".join(f"contains(text, '{w}')" for w in words) + ")"


_DATE_DUCK = "(regexp_matches(text, '\\d{1,2}\\s*월\\s*\\d{1,2}\\s*일') or regexp_matches(text, '(^|[^0-9.])\\d{1,2}[./]\\d{1,2}($|[^0-9])'))"
_CAT_DUCK = (
    "case when regexp_matches(text, '\\d\\s*원') then '비용' " + " ".join(f"when {_any(w)} then '{k}'" for k, w in P.RULE_WORDS)
    + f" when {_DATE_DUCK} or regexp_matches(text, '(^|[^0-9])([1-9]|1[012])월') or {_any(P.SCHEDULE_WORDS)} then '일정' else '기타' end"
)
_IMP_DUCK = (
    "(least(100, case cat " + " ".join(f"when '{k}' then {round(v * 100)}" for k, v in P.BASE_IMPORTANCE.items()) + f" end + case when {_any(P.URGENT_WORDS)} then 5 else 0 end + case when {_DATE_DUCK} then 5 else 0 end) / 100.0)::double"
)


@query(f"with {N_DUCK} select notice_id, {_CAT_DUCK} as category from n")
def rule_category(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", rules.category(F.col("text")).alias("category"))


@query(f"with {N_DUCK}, c as (select *, {_CAT_DUCK} as cat from n) select notice_id, {_IMP_DUCK} as importance from c")
def rule_importance(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", rules.importance(F.col("text"), rules.category(F.col("text"))).alias("importance"))


@query(f"with {N_DUCK} select notice_id, case " + " ".join(f"when {_any(w)} then '{k}'" for k, w in P.GUESS_WORDS) + " else '기타' end as category from n")
def guessed_category(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", rules.guess_category(F.col("text")).alias("category"))


@query(f"with {N_DUCK}, c as (select {_CAT_DUCK} as category from n) select category, count(*) as n, count(*) * 100.0 / sum(count(*)) over () as pct from c group by category")
def category_distribution(spark, sf_dir):
    return corpus.distribution(notices(spark, sf_dir).select(rules.category(F.col("text")).alias("category")), "category")


@query("with c as (select quality, count(*) as n from labels group by quality) select max(n) as largest, min(n) as smallest, max(n) / min(n) as ratio from c")
def label_imbalance(spark, sf_dir):
    return corpus.imbalance(table(spark, sf_dir, "labels"), "quality")


# cards


@query()
def notice_cards(spark, sf_dir):
    """Cards of every notice in Vietnamese form: at most eight each."""
    out = cards.analyze(spread_notices(spark, sf_dir), "vi", GLOSSARY)
    return cards.exploded(out, "notice_id").select("notice_id", "pos", "c.*")


@query()
def notice_analysis(spark, sf_dir):
    out = cards.analyze(spread_notices(spark, sf_dir), "en", [])
    return out.select("notice_id", F.to_json("items").alias("items"), F.to_json("summary").alias("summary"), "tts_text", "tts_text_easy_ko")


@query()
def notice_todos(spark, sf_dir):
    return cards.todos(spread_notices(spark, sf_dir), "notice_id")


_HEADED_DUCK = "(?s)^\\s*(" + "|".join(sorted(P.HEADERS, key=lambda h: (-len(h), P.HEADERS.index(h)))) + ")\\s*[|:：]?\\s*(.+)$"


@query(f"""with {N_DUCK}, h as (select notice_id, trim(text) as text, nullif(regexp_extract(trim(text), '{_HEADED_DUCK}', 1), '') as header from n)
  select notice_id, header, case when header is null then text else trim(regexp_extract(text, '{_HEADED_DUCK}', 2)) end as value from h""")
def header_value(spark, sf_dir):
    t = F.col("text")
    return notices(spark, sf_dir).select("notice_id", cards.header(t).alias("header"), cards.value(t).alias("value"))


@query()
def easy_korean(spark, sf_dir):
    return notices(spark, sf_dir).select("notice_id", easy.easy_korean(F.col("text")).alias("easy"))


@query("""with o as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as i from orders)
  select o_custkey, o_orderkey, o_totalprice from o where i <= 8""")
def top8_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return cards.top_per_group(o, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")])


# documents


_STRIP = "regexp_replace(regexp_replace({}, '^[\\s]+', ''), '[\\s]+$', '')"


@query("""with l as (select doc_id, list_transform(string_split(replace(text, chr(0), ' '), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(11) || chr(12) || chr(13))) as ls from documents)
  select doc_id, sha256(trim(regexp_replace(array_to_string(ls, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) as text_sha256 from l""")
def doc_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("text_sha256"))


@query("select doc_id, sha256(trim(regexp_replace(replace(text, chr(0), ' '), '\\s+', ' ', 'g'))) as text_sha256 from documents")
def doc_flatten(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.flatten(F.col("text")), 256).alias("text_sha256"))


@query("select doc_id, sha256(trim(regexp_replace(replace(replace(text, chr(0), ''), chr(13), ''), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12))) as text_sha256 from documents")
def doc_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.clean(F.col("text")), 256).alias("text_sha256"))


@query("""with p as (select doc_id, trim(unnest(regexp_split_to_array(text, '[.。\\n]')), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as sentence from documents)
  select doc_id, count(*) as n, sum(length(sentence)) as chars from p where length(sentence) > 8 group by doc_id""")
def doc_sentences(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.clauses(F.col("text"))).alias("s"))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("s")).alias("chars"))


@query()
def doc_sentences_lookbehind(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(text.sentences(F.col("text"))).alias("notice"), F.size(text.sentences(F.col("text"), plain=True)).alias("plain"), F.size(text.sentences_by_mark(F.col("text"))).alias("by_mark"), F.size(text.sentences_simple(F.col("text"))).alias("simple"))


@query("select doc_id, len(regexp_extract_all(text, '\\d+[.)] ')) as items from documents where regexp_matches(text, '\\d+[.)] ')")
def doc_numbered_items(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\d+[.)] ")).select("doc_id", F.size(text.matches(F.col("text"), r"\d+[.)] ")).alias("items"))


@query("""select lang, count(*) as n, min(length(text)) as least, max(length(text)) as most, avg(length(text)) as mean, cast(floor(median(length(text))) as bigint) as median, coalesce(stddev_samp(length(text)), 0) as stdev
  from documents group by lang""")
def doc_length_stats(spark, sf_dir):
    return corpus.length_stats(table(spark, sf_dir, "documents"), F.char_length("text"), "lang")


@query("select min(doc_id) as doc_id, sha256(text) as text_sha256 from documents group by text")
def doc_dedup_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2("text", 256)).select("doc_id", "text_sha256")
    return corpus.keep_first(d, ["text_sha256"], F.col("doc_id"))


@query("""with u as (select 0 as src, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
  r as (select *, row_number() over (partition by text order by src, id) as i from u) select src, id from r where i = 1""")
def doc_union_dedup(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.lit(0).alias("src"), F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("src"), F.col("item_id").alias("id"), "text")
    return corpus.keep_first(corpus.union(a, b).withColumn("h", F.sha2("text", 256)).drop("text"), ["h"], F.col("src"), F.col("id")).drop("h")


_SPLIT = """r as (select l.doc_id, lang, row_number() over (partition by lang order by (l.doc_id * 7919) % 10007, l.doc_id) as i, count(*) over (partition by lang) as n from labels l join documents d using (doc_id)),
  s as (select doc_id, lang, case when i <= greatest(1, round_even(n * 0.8, 0)) then 'train' when i <= greatest(1, round_even(n * 0.8, 0)) + greatest(1, round_even(n * 0.1, 0)) then 'val' else 'test' end as split from r)"""


def _split(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return corpus.stratified_split(d, "lang", F.col("doc_id") * 7919 % 10007, F.col("doc_id"))


@query(f"with {_SPLIT} select doc_id, lang, split from s")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query(f"with {_SPLIT} select lang, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val, count(*) filter (where split = 'test') as test from s group by lang")
def split_contingency(spark, sf_dir):
    return corpus.contingency(_split(spark, sf_dir), "lang", "split", ["train", "val", "test"])


@query("select 'url' as column_name, count(*) filter (where trim(coalesce(url, '')) <> '') as filled, count(*) filter (where trim(coalesce(url, '')) = '') as empty from pages union all select 'html', count(*) filter (where trim(coalesce(html, '')) <> ''), count(*) filter (where trim(coalesce(html, '')) = '') from pages")
def filled_cells(spark, sf_dir):
    return corpus.filled(table(spark, sf_dir, "pages"), ["url", "html"])


@query("select source, count(*) as n, count(*) * 100.0 / sum(count(*)) over () as pct from documents group by source")
def source_distribution(spark, sf_dir):
    return corpus.distribution(table(spark, sf_dir, "documents"), "source")


@query("select doc_id, quality, (count(*) over ())::double / (2 * count(*) over (partition by quality)) as weight from labels")
def class_weights(spark, sf_dir):
    return corpus.class_weights(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality")


@query("select page_id, 9 + row_number() over (order by url) as id from pages")
def sequential_ids(spark, sf_dir):
    return corpus.numbered(table(spark, sf_dir, "pages").select("page_id", "url"), "url", 10, then=("page_id",)).select("page_id", "id")


# glossary


@query(f"with {_TERMS_DUCK} select doc_id, pos, korean, preferred from documents join terms on contains(text, korean) where preferred <> ''")
def term_hits(spark, sf_dir):
    g = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(TERMS)], "pos int, korean string, preferred string")
    return terms.term_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), g).select("doc_id", "pos", "korean", "preferred")


_PART_TERMS = """select term as korean, min(p_partkey) as pos, min(p_type) as preferred from (select p_partkey, p_type, case
  when p_partkey % 100 = 0 then substr(p_name, 1, 1) when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then substr(p_name, length(p_name) - 2, 3) else substr(p_name, 2, 2 + p_partkey % 3) end as term from {part}) group by term"""


@query(f"with g as ({_PART_TERMS.format(part='part')}) select doc_id, pos, korean, preferred from documents join g on contains(text, korean)")
def part_term_hits(spark, sf_dir):
    """A glossary of names of parts, pieces of them and single letters."""
    g = spark.sql(_PART_TERMS, part=table(spark, sf_dir, "part"))
    return terms.term_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), g).select("doc_id", "pos", "korean", "preferred")


@query("select p_partkey, case trim(p_brand) when 'Brand#11' then 'một' when 'Brand#22' then 'hai' else p_brand end as shown from part")
def term_exact(spark, sf_dir):
    g = glossary.literal([("Brand#11", "một"), ("Brand#22", "hai"), ("Brand#33", "")])
    return table(spark, sf_dir, "part").select("p_partkey", glossary.term(F.col("p_brand"), g, F.lit("vi")).alias("shown"))


@query("""select doc_id, sha256(replace(replace(replace(replace(replace(text, 'that', 'that(que)'), 'tion', 'tion(ción)'), 'the', 'the(le)'), 'and', 'and(et)'), 'ung', 'ung(ing)')) as text_sha256 from documents""")
def term_injection(spark, sf_dir):
    g = glossary.literal(TERMS)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(glossary.injected(F.col("text"), glossary.hits(F.col("text"), g)), 256).alias("text_sha256"))


_CHECK = f"""with {_TERMS_DUCK}, h as (select conv_id, turn, pos, korean, preferred, contains(lower(text), lower(preferred)) as there from conversations join terms on contains(text, korean) where preferred <> '')"""


@query(f"{_CHECK} select conv_id, turn, korean as korean_term, preferred as preferred_term, 'Y' as found_in_input, case when there then 'Y' else 'N' end as found_in_translation, case when there then 'ok' else 'missing_term' end as quality_label, case when there then '{P.NOTE_OK}' else '{P.NOTE_MISSING}' end as note from h union all select conv_id, turn, '', '', 'N', 'N', 'unchecked', '{P.NOTE_UNCHECKED}' from conversations c where not exists (select 1 from h where h.conv_id = c.conv_id and h.turn = c.turn)")
def coverage_check(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("h", glossary.hits(F.col("text"), glossary.literal(TERMS)))
    return c.select("conv_id", "turn", F.inline(glossary.checks(F.col("text"), F.col("text"), F.col("h"))))


@query(f"""{_CHECK}, g as (select conv_id, turn, count(*) as n, string_agg(case when not there then korean || '->' || preferred end, '; ' order by pos) as notes from h group by conv_id, turn)
  select c.conv_id, c.turn, case when g.n is null then 'unchecked' when notes is not null then 'review_needed' else 'ok' end as label, case when g.n is null then '{P.NOTE_UNCHECKED}' else coalesce(notes, '') end as note
  from conversations c left join g on c.conv_id = g.conv_id and c.turn = g.turn""")
def quality_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("h", glossary.hits(F.col("text"), glossary.literal(TERMS)))
    c = c.withColumn("r", glossary.roll_up(glossary.checks(F.col("text"), F.col("text"), F.col("h"))))
    return c.select("conv_id", "turn", "r.label", "r.note")


@query("""select lang, count(*) filter (where source <> '') as n_terms, count(*) filter (where source <> '' and contains(text, 'the')) as n_reflected,
  case when count(*) filter (where source <> '') > 0 then count(*) filter (where source <> '' and contains(text, 'the')) * 100.0 / count(*) filter (where source <> '') end as rate from documents group by lang""")
def reflection_rate(spark, sf_dir):
    return evals.reflection(table(spark, sf_dir, "documents"), "lang", "source", F.col("text").contains("the"))


@query("select lang, count(*) as n from (select unnest(['vi', 'en']) as lang) cross join (select distinct source from documents) group by lang")
def terms_by_language(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    return judges.by_language(sources, ["vi", "en"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query()
def mask_restore_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.withColumn("m", glossary.masked(F.col("text")))
    return d.select("doc_id", F.size("m.kept").alias("n_kept"), (glossary.unmasked(F.col("m.text"), F.col("m.kept")) == F.col("text")).alias("same"))


# users and inboxes


_USERS = "u as (select c_custkey as user_id, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'parent' else 'teacher' end as role from customer)"


def _users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "parent").otherwise("teacher").alias("role"))


@query(f"with {N_DUCK} select notice_id, parent_id, text from n where parent_id = 7")
def user_inbox(spark, sf_dir):
    return corpus.inbox(notices(spark, sf_dir), 7)


@query("select count(*) as deleted from orders where o_custkey = 7")
def inbox_delete_counts(spark, sf_dir):
    return corpus.without(notices(spark, sf_dir), 7)[1]


@query(f"with {N_DUCK}, {_USERS} select notice_id, parent_id from n where parent_id in (select user_id from u where role = 'parent')")
def role_semi_join(spark, sf_dir):
    return corpus.allowed(notices(spark, sf_dir).select("notice_id", "parent_id"), _users(spark, sf_dir), "parent")


@query(f"with {_USERS} select user_id, case when user_id % 10 = 0 then 'admin' else role end as role from u")
def user_upsert(spark, sf_dir):
    u = _users(spark, sf_dir)
    return corpus.upsert(u, u.filter("user_id % 10 = 0").withColumn("role", F.lit("admin")), "user_id")


@query(f"""with {N_DUCK}, c as (select *, notice_id // 4 as original_id, {_CAT_DUCK} as cat from n), i as (select *, {_IMP_DUCK} as imp from c),
  g as (select original_id, list(cat order by notice_id) filter (where notice_id % 3 <> 0) as cats, list(substr(text, 1, 60) order by notice_id) filter (where notice_id % 3 <> 0 and imp >= 0.70) as kws,
        max(imp) filter (where notice_id % 3 <> 0) as top from i group by original_id)
  select original_id, coalesce((select string_agg(x, ', ' order by p) from (select x, min(p) as p from (select unnest(cats) as x, generate_subscripts(cats, 1) as p) group by x)), '') as category,
  coalesce(array_to_string(kws[1:5], ' / '), '') as keywords, coalesce(top::varchar, '') as importance from g""")
def label_aggregation(spark, sf_dir):
    n = notices(spark, sf_dir).select(F.expr("notice_id div 4").alias("original_id"), F.col("notice_id").alias("pos"), F.col("text").alias("sentence"), (F.col("notice_id") % 3 != 0).alias("is_todo"), F.lit("").alias("category"))
    return corpus.aggregate_sentences(n, "original_id")


@query("select d.doc_id, case when quality is not null then 'labelled' else 'rule' end as origin, coalesce(quality, case when n_chars > 1000 then 1 else 0 end) as quality from documents d left join labels l using (doc_id)")
def left_join_fallback(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return corpus.filled_from(d, lab, "doc_id", "quality", F.when(F.col("n_chars") > 1000, 1).otherwise(0)).select("doc_id", "origin", "quality")


@query()
def original_fill(spark, sf_dir):
    n = notices(spark, sf_dir)
    s = n.filter("notice_id % 3 = 0").select(F.col("notice_id").alias("original_id"), F.lit(0).alias("pos"), F.col("text").alias("sentence"), F.lit(True).alias("is_todo"), F.lit("").alias("category"))
    return corpus.fill_originals(n.select(F.col("notice_id").alias("id"), F.col("text").alias("original_text")), s)


# evaluation


@query("""select t.quality, count(*) filter (where toxic = 0) as "0", count(*) filter (where toxic = 1) as "1" from (select unnest([0, 1]) as quality) t left join labels l on t.quality = l.quality group by t.quality""")
def confusion(spark, sf_dir):
    return evals.confusion(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


_PRF = """c as (select x as label, count(*) filter (where quality = x and toxic = x) as tp, count(*) filter (where toxic = x) as pp, count(*) filter (where quality = x) as support from labels, (select unnest([0, 1, 2]) as x) group by x),
  m as (select label, case when pp = 0 then 0 else tp / pp end as p, case when support = 0 then 0 else tp / support end as r, support from c),
  f as (select label, p as "precision", r as recall, case when p + r = 0 then 0 else p * r * 2 / (p + r) end as f1, support from m)"""


@query(f"with {_PRF} select * from f")
def prf1(spark, sf_dir):
    return evals.per_class(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1, 2])


@query(f'with {_PRF} select avg("precision") as "precision", avg(recall) as recall, avg(f1) as f1 from f')
def macro_prf1(spark, sf_dir):
    return evals.macro(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1, 2])


@query("select avg((quality = toxic)::int) as accuracy, 2.0 * count(*) filter (where quality = 1 and toxic = 1) / (count(*) filter (where toxic = 1) + count(*) filter (where quality = 1)) as f1 from labels")
def binary_metrics(spark, sf_dir):
    return evals.binary(table(spark, sf_dir, "labels"), "quality", "toxic")


_SWEEP = """j as (select quality, least(n_chars / 5000.0, 1.0)::double as score from labels join documents using (doc_id)),
  s as (select t as threshold, count(*) filter (where quality = 1 and score >= t) as tp, count(*) filter (where score >= t) as n, count(*) filter (where quality = 1) as pos from j, (select unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])::double as t) group by t),
  m as (select threshold, case when n = 0 then 0 else tp / n end as p, case when pos = 0 then 0 else tp / pos end as r, n from s),
  f as (select threshold, p as "precision", r as recall, case when p + r = 0 then 0 else p * r * 2 / (p + r) end as f1, n as n_predicted from m)"""
THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "quality", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"))


@query(f"with {_SWEEP} select * from f")
def threshold_sweep(spark, sf_dir):
    return evals.sweep(_scored(spark, sf_dir), "quality", "score", THRESHOLDS)


@query(f"with {_SWEEP} select threshold, f1 from f order by f1 desc, threshold limit 1")
def best_threshold(spark, sf_dir):
    return evals.best_threshold(_scored(spark, sf_dir), "quality", "score", THRESHOLDS)


@query("""with j as (select doc_id, quality, least(n_chars / 5000.0, 1.0)::double as score from labels join documents using (doc_id))
  (select doc_id, quality, score, 'fn' as kind from j where quality = 1 and score < 0.5 order by score, doc_id limit 10) union all (select doc_id, quality, score, 'fp' from j where quality = 0 and score >= 0.5 order by score desc, doc_id limit 10)""")
def worst_misses(spark, sf_dir):
    return evals.worst_misses(_scored(spark, sf_dir), "quality", "score", 0.5, "doc_id")


_TURNS = """t as (select conv_id, string_agg(text, ' ' order by turn) as full_text, coalesce(string_agg(text, ' ' order by turn) filter (where role = 'user'), '') as part_text from conversations group by conv_id)"""


def _turns(spark, sf_dir):
    return evals.turns_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", F.col("role") == "user")


@query(f"with {_TURNS} select conv_id, sha256(full_text) as full_sha256, sha256(part_text) as part_sha256 from t")
def turn_concat(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", F.sha2("full_text", 256).alias("full_sha256"), F.sha2("part_text", 256).alias("part_sha256"))


@query(f"with {_TURNS} select conv_id, length(full_text) as full_chars, length(part_text) as part_chars, case when length(full_text) = 0 then 0 else (1 - length(part_text)::double / length(full_text)) * 100 end as reduction from t")
def ab_reduction(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", F.char_length("full_text").alias("full_chars"), F.char_length("part_text").alias("part_chars"), evals.reduction(F.char_length("full_text"), F.char_length("part_text")).alias("reduction"))


@query("""with g as (select o_custkey, avg(o_totalprice) filter (where o_orderkey % 2 = 0) / 1000 as a, avg(o_totalprice) filter (where o_orderkey % 2 = 1) / 1000 as b from orders group by o_custkey)
  select o_custkey, case when b - a > 5 then 'B better' when b - a < -5 then 'A better' else 'tie' end as verdict from g""")
def ab_verdict(spark, sf_dir):
    p = F.col("o_totalprice")
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.avg(F.when(F.col("o_orderkey") % 2 == 0, p)) / 1000).alias("a"), (F.avg(F.when(F.col("o_orderkey") % 2 == 1, p)) / 1000).alias("b"))
    return g.select("o_custkey", evals.verdict(F.col("b") - F.col("a")).alias("verdict"))


@query("""with e as (select o_orderpriority as grp, round(avg(cast(o_totalprice as decimal(20,4))), 1) as before, round(avg(cast(o_totalprice * 1.25 as decimal(20,4))), 1) as after from orders group by 1),
  t as (select * from e union all select '전체', round(avg(before), 1), round(avg(after), 1) from e) select grp, before, after, round(after - before, 1) as delta from t""")
def two_level_mean(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("after_price", F.col("o_totalprice") * 1.25)
    out = evals.two_level_mean(o, "o_orderpriority", "o_totalprice", "after_price")
    return out.select("grp", *(F.col(c).cast("double").alias(c) for c in ("before", "after", "delta")))


@query("select event_id, json_keys(props)[1] as first_key, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value from events")
def json_field(spark, sf_dir):
    """The fields of an answer in a code fence, made of the event's properties."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```")).alias("answer"))
    e = e.select("event_id", evals.fenced_json(F.col("answer"), "map<string,string>").alias("m")).withColumn("k", F.get(F.map_keys("m"), F.lit(0)))
    return e.select("event_id", F.col("k").alias("first_key"), F.element_at("m", F.col("k")).alias("first_value"))


@query("select event_id, greatest(0, least(95, round_even(value, 0)))::int as score from events")
def clamp_score(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", evals.clamp(F.col("value").cast("string"), 95).alias("score"))


@query()
def greedy_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(corpus.greedy_chunks(text.sentences_by_mark(F.col("text")), 384)).alias("pos", "chunk"))


@query()
def term_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(corpus.select_sentences(text.sentences_by_mark(F.col("text")), F.array(F.lit("tion"), F.lit("ung"))), "\n").alias("chosen"))


# pages, streaming, files, graphs


@query("select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, rtrim(url, '.,)]') as url from pages")
def page_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(slots.urls(F.col("url"))).alias("url"))
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), "url")


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def event_windows(spark, sf_dir):
    out = inbox.windowed_counts(table(spark, sf_dir, "events").select("ts", "event_type", "value"), "event_type")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select p_partkey, case p_size % 6 when 0 then 'pdf' when 1 then 'convert' when 2 then 'text' when 3 then 'text' when 4 then 'skip' else 'text' end as route from part")
def file_routes(spark, sf_dir):
    ends = F.array(*map(F.lit, [".PDF", ".hwp", ".txt", ".md", ".exe", ""]))
    return table(spark, sf_dir, "part").select("p_partkey", files.route(F.concat(F.lit("f"), F.get(ends, F.col("p_size") % 6))).alias("route"))


@query("""with recursive e as (select distinct o_custkey as u, -(o_orderkey % 500) - 1 as v from orders), b as (select u, v from e union select v, u from e), r(node, label) as (select u, u from b union select b.v, r.label from r join b on r.node = b.u)
  select node, min(label) as label from r group by node""")
def components(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u"), (-(F.col("o_orderkey") % 500) - 1).alias("v"))
    return graph.components(o.distinct())


@query()
def offline_pipeline(spark, sf_dir):
    rows = notices(spark, sf_dir).select(F.col("notice_id").cast("string").alias("id"), F.col("text").alias("original_text"), F.when(F.col("notice_id") % 5 == 0, "비용").otherwise("").alias("category"))
    out = offline.run(rows, GLOSSARY)
    return out.select("id", "category", "easy_text", F.size("chunks").alias("n_chunks"), F.to_json("checks").alias("checks"), "quality_label", "note")


@query()
def legacy_todos(spark, sf_dir):
    return offline.legacy_todos(notices(spark, sf_dir), "notice_id")


@query("select p_partkey, case when p_size % 3 = 0 then 'filled' || (p_partkey % 2)::varchar else p_brand end as shown from part where p_partkey % 2 = 0 union all select p_partkey, case when p_size % 3 = 0 then '' else p_brand end from part where p_partkey % 2 = 1")
def blank_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_brand")).alias("shown"))
    s = p.filter("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("filled"), (F.col("p_partkey") % 2).cast("string")).alias("suggestion"))
    return corpus.fill_blank(p, s, "p_partkey", "shown")
