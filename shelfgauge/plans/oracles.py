"""Equivalent SQL for the registered queries, to be run by another engine on the same tables.

Written from the rules, not from the DataFrame code: regular expressions where the
package trims character sets, global windows where it numbers partitions, JSON
functions where it uses variants.
"""

from __future__ import annotations

from shelfgauge.operators.requests import PROMPT, STRICT_PROMPT
from shelfgauge.operators.scoring import GENDER_WORDS
from shelfgauge.plans import fixtures
from shelfgauge.schema import MODEL_COLUMNS, NA_TOKENS, REQUIRED_COLUMNS, RESULT_KEYS

_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_WORD = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(value: str) -> str:
    return f"regexp_replace({value}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _missing(value: str) -> str:
    return f"coalesce({_strip(value)}, '') = ''"


_TOKENS = ", ".join(map(_quote, NA_TOKENS))


def _cleaned(source: str) -> str:
    cells = ", ".join(
        f"case when {name} in ({_TOKENS}) then null else {_strip(name)} end as {name}"
        for name in REQUIRED_COLUMNS
    )
    return f"select {cells} from {source}"


FEED = f"feed as ({fixtures.for_oracle(fixtures.FEED)})"
RESULTS = f"ai as ({fixtures.for_oracle(fixtures.RESULTS)})"
ANSWERS = f"resp as ({fixtures.for_oracle(fixtures.ANSWERS)})"

_WORDS = f"coalesce(len(regexp_extract_all(description, '{_WORD}')), 0)"
_PRICE = "try_cast(price as double)"
_GENDER = " or ".join(f"contains(lower(title), {_quote(word)})" for word in GENDER_WORDS)

# Fixed values: (condition, points, issue, attribute) of each rule.
_RULES = (
    (_missing("material"), 20, "'Missing material'", "'material'"),
    (_missing("colour"), 10, "'Missing colour'", "'colour'"),
    (
        f"not ({_missing('colour')}) and regexp_matches(colour, '[/&]')",
        10,
        f"'Ambiguous colour value: ''' || {_strip('colour')} || ''''",
        "null",
    ),
    (f"{_WORDS} = 0", 15, "'Missing description'", "'description'"),
    (
        f"{_WORDS} between 1 and 19",
        15,
        f"'Description too short (' || {_WORDS} || ' words, need ≥20)'",
        "null",
    ),
    (f"not coalesce({_GENDER}, false)", 10, "'Title missing gender indicator'", "null"),
    (_missing("keywords"), 10, "'Missing keywords'", "'keywords'"),
    (f"coalesce({_PRICE} <= 0, false)", 15, "'Price is zero or negative'", "null"),
    (f"{_PRICE} is null", 15, "'Missing or invalid price'", "'price'"),
    (_missing("stock_status"), 5, "'Missing stock_status'", "'stock_status'"),
)


def _listed(which: int) -> str:
    cells = ", ".join(f"case when {rule[0]} then {rule[which]} end" for rule in _RULES)
    joined = f"array_to_string(list_filter([{cells}], lambda x: x is not null), '; ')"
    return f"coalesce(nullif({joined}, ''), 'None')"


_LOST = " + ".join(f"case when {rule[0]} then {rule[1]} else 0 end" for rule in _RULES)
SCORED = f"""marked as (
  select *, cast(greatest(0, 100 - ({_LOST})) as integer) as pre_score,
    {_listed(2)} as pre_issues, {_listed(3)} as pre_missing_attributes
  from feed),
scored as (
  select *, case when pre_score >= 90 then 'A' when pre_score >= 75 then 'B'
    when pre_score >= 60 then 'C' when pre_score >= 45 then 'D' else 'F' end as pre_grade
  from marked)"""

_FEED_COLUMNS = ", ".join(f"f.{name}" for name in REQUIRED_COLUMNS)
_SCORE = "cast(trunc(try_cast({0} as double)) as bigint)"
MERGED = f"""merged as (
  select {_FEED_COLUMNS},
    coalesce({_SCORE.format("a.quality_score")}, 0) as quality_score,
    coalesce(a.grade, 'F') as grade,
    case when a.product_id is null then 'Analysis failed' else coalesce(a.issues, '') end
      as issues,
    coalesce(a.suggested_title, '') as suggested_title,
    coalesce(a.suggested_description, '') as suggested_description,
    coalesce(a.suggested_keywords, '') as suggested_keywords,
    coalesce(a.missing_attributes, '') as missing_attributes,
    coalesce(a.improvement_priority, 'High') as improvement_priority
  from feed f left join ai a on a.product_id = f.product_id)"""

_ENRICHED = ", ".join((*REQUIRED_COLUMNS, *MODEL_COLUMNS))


def _on_feed(body: str) -> str:
    return f"with {FEED} {body}"


def _on_scored(body: str) -> str:
    return f"with {FEED}, {SCORED} {body}"


def _on_merged(body: str) -> str:
    return f"with {FEED}, {RESULTS}, {MERGED} {body}"


def _numbered(order: str) -> str:
    return f"numbered as (select *, row_number() over (order by {order}) - 1 as pos from feed)"


def _batches(order: str) -> str:
    return (
        f"with {FEED}, {_numbered(order)} select product_id, "
        "cast(pos // 8 as bigint) as batch_id, cast(pos % 8 as integer) as item_no from numbered"
    )


_FENCE = r"```"
_CLEAN = _strip(
    "regexp_replace(regexp_replace("
    + _strip("raw")
    + rf", '(?i)^{_FENCE}(?:json)?{_BLANK}*', ''), '{_BLANK}*{_FENCE}$', '')"
)
PARSED = f"""cleaned as (select *, {_CLEAN} as t from resp),
parsed as (
  select batch_id, n, attempt, t,
    case when json_valid(t) then case when json_type(t) = 'ARRAY' then t end end as arr,
  from cleaned),
counted as (select *, cast(json_array_length(arr) as integer) as n_items from parsed),
checked as (
  select *, coalesce(n_items = n and len(list_filter(
      list_transform(range(n_items), lambda i: json_extract(arr, '$[' || i || ']')),
      lambda o: json_type(o) = 'OBJECT' and len(list_intersect(json_keys(o),
        [{", ".join(map(_quote, RESULT_KEYS))}])) = 9)) = n, false) as valid
  from counted)"""

_TEXTS = ("grade", "suggested_title", "suggested_description", "suggested_keywords")


def _json_list(name: str) -> str:
    return f"array_to_string(cast(json_extract(o, '$.{name}') as varchar[]), '; ') as {name}"


def _json_text(name: str) -> str:
    return f"json_extract_string(o, '$.{name}') as {name}"


RESOLVED = f"""picked as (
  select * from checked where (attempt = 1 and valid) or (attempt = 2 and n_items > 0)
  qualify row_number() over (partition by batch_id order by attempt) = 1),
opened as (
  select batch_id, attempt, cast(i as integer) as item_no,
    json_extract(arr, '$[' || i || ']') as o
  from (select *, unnest(range(n_items)) as i from picked) u),
placed as (
  select *, cast(k // 8 as bigint) as batch_id, cast(k % 8 as integer) as item_no
  from (select *, cast(substr(product_id, 2) as bigint) as k from feed) f),
resolved as (
  select batch_id, attempt, item_no, {_json_text("product_id")}, {_json_text("quality_score")},
    {_json_text("improvement_priority")}, {_json_list("issues")},
    {_json_list("missing_attributes")}, {", ".join(map(_json_text, _TEXTS))}
  from opened
  union all by name
  select batch_id, cast(0 as integer) as attempt, item_no, product_id, '0' as quality_score,
    'High' as improvement_priority, 'LLM analysis failed for this product' as issues,
    '' as missing_attributes, 'F' as grade, coalesce(title, '') as suggested_title,
    '' as suggested_description, '' as suggested_keywords
  from placed where batch_id not in (select batch_id from picked))"""

_PRODUCT_JSON = (
    "to_json({" + ", ".join(f"{_quote(name)}: {name}" for name in REQUIRED_COLUMNS) + "})"
)


def _prompt(template: str, name: str) -> str:
    text = _quote(template).replace("{n}", "' || n || '").replace("{products}", "' || js || '")
    return f"{text} as {name}"


# The stand-in model fails once for every third first product, twice for every sixth.
_EMPTY = ", ".join(f"case when {name} is null then '{name}' end" for name in REQUIRED_COLUMNS)
ENRICHED_BY_MODEL = f"""
with {FEED}, {_numbered("product_id")},
led as (
  select *, first_value(cast(substr(product_id, 2) as bigint))
    over (partition by pos // 8 order by pos) % 6 = 0 as failed,
    list_filter([{_EMPTY}], lambda x: x is not null) as gaps
  from numbered)
select product_id,
  cast(case when failed then 0 else 100 - 10 * len(gaps) end as bigint) as quality_score,
  case when failed then 'F' else 'B' end as grade,
  case when failed then 'LLM analysis failed for this product'
    else array_to_string(list_transform(gaps, lambda x: x || ' is empty'), '; ') end as issues,
  case when failed then '' else array_to_string(gaps, '; ') end as missing_attributes,
  case when failed then title else 'New ' || title end as suggested_title,
  '' as suggested_description,
  case when failed then 'High' else 'Low' end as improvement_priority,
  'own ' || product_id as item_no
from led"""
#: the same over a feed that went through CSV, where blank cells are nothing
ENRICHED_STREAM = "select * exclude (item_no) from (" + ENRICHED_BY_MODEL.replace(
    FEED, f"sent as ({fixtures.for_oracle(fixtures.FEED)}), feed as ({_cleaned('sent')})"
) + ") s"

_GIVEN = f"""feed as ({fixtures.for_oracle(fixtures.REPEATED_FEED)}),
given as ({fixtures.for_oracle(fixtures.REPEATED_RESULTS)})"""


def _merged_repeats(results: str) -> str:
    merged = MERGED.replace("from feed f", ", f.copy from feed f")
    columns = ", ".join(("product_id", "title", "copy", *MODEL_COLUMNS))
    return f"with {_GIVEN}, ai as ({results}), {merged} select {columns} from merged"


_FIGURES = """select 'scalar' as part, name, number from (
    unpivot (
      select cast(count(*) as double) as total_products,
        cast(format('{:.1f}', cast(avg(quality_score) as double)) as double) as average_quality_score,
        cast(count(*) filter (quality_score < 60) as double) as products_needing_review,
        cast(20 as double) as n_columns,
        cast(format('{:.1f}', cast(100 - cast(format('{:.1f}', cast(avg(quality_score) as double)) as double) as double)) as double) as points_from_perfect,
        cast(format('{:.1f}', cast(count(*) filter (quality_score < 60) * cast(0.25 as double) as double)) as double) as hours_saved
      from merged)
    on columns(*) into name name value number) u
  union all
  select 'grade', g.grade, cast(count(m.product_id) as double)
  from (values ('A'), ('B'), ('C'), ('D'), ('F')) g(grade)
  left join merged m on m.grade = g.grade group by g.grade
  union all
  select 'worst', product_id, cast(quality_score as double)
  from (select * from merged order by quality_score, product_id limit 5) w
  union all
  select 'attribute', attribute, cast(count(*) as double) from (select """ + _strip(
    "unnest(string_split(missing_attributes, ';'))"
) + """ as attribute from merged) a
  where attribute <> '' and lower(attribute) <> 'none' group by attribute"""


def _badge_rows() -> str:
    rows = [
        f"select product_id, 'before' as side, cast({at} as integer) as field_no, "
        f"'{name}' as field, case when {name} is null or {name} in ('', 'nan') then '—' "
        f"else {name} end as value, "
        f"coalesce({_strip(name)}, '') in ('', 'nan', '0', '0.0') as missing from merged"
        for at, name in enumerate(REQUIRED_COLUMNS)
    ]
    after = (
        "suggested_title",
        "suggested_description",
        "suggested_keywords",
        "missing_attributes",
    )
    rows += [
        f"select product_id, 'after' as side, cast({at} as integer) as field_no, "
        f"'{name}' as field, case when {name} in ('', 'nan') then '—' "
        f"else {_strip(name)} end as value, false as missing from merged"
        for at, name in enumerate(after, len(REQUIRED_COLUMNS))
    ]
    return " union all ".join(rows)


_BADGES = ", ".join(
    f"case when coalesce({_strip(name)}, '') in ('', 'nan', '0', '0.0') then '{name}' end"
    for name in REQUIRED_COLUMNS
)
_SHOWN = (
    "case when lower(issues) in ('nan', 'none') then '' else array_to_string(list_filter("
    "list_transform(string_split(issues, ';'), lambda x: "
    + _strip("x")
    + "), lambda x: x <> ''), '|') end"
)

def _csv_cell(name: str) -> str:
    quoted = f"""'"' || replace({name}, '"', '""') || '"'"""
    text = f"cast({name} as varchar)"
    return f"""case when {name} is null then '' when regexp_matches({text}, '[,"\\n\\r]') then {quoted.replace(name, text)} else {text} end"""


_LINE = " || ',' || ".join(_csv_cell(name) for name in (*REQUIRED_COLUMNS, *MODEL_COLUMNS))
_HEADER = ",".join((*REQUIRED_COLUMNS, *MODEL_COLUMNS))
ORDERED_EXPORT = _on_merged(
    f"""select row_number() over (order by part, product_id nulls last, line, nth) - 1 as position, piece as line
    from (
      select part, product_id, line, unnest(string_split(line, chr(10))) as piece,
        generate_subscripts(string_split(line, chr(10)), 1) as nth
      from (select 0 as part, null as product_id, '{_HEADER}' as line
        union all select 1, product_id, {_LINE} from merged) l) p"""
)

#: The odd products arrive first, then the even ones.
STREAM_BATCHES = f"""with {FEED}, told as (
  select product_id, case when right(product_id, 1) in ('1', '3', '5', '7', '9') then 0 else 1 end as delivery from feed),
placed as (
  select *, row_number() over (partition by delivery order by product_id) - 1 as pos from told),
sizes as (select ceil(count(*) filter (delivery = 0) / 8.0) as before from told)
select product_id, cast(pos // 8 + delivery * before as bigint) as batch_id, cast(pos % 8 as integer) as item_no
from placed, sizes"""

_DEARER = "feed as (select * replace (case when right(product_id, 1) = '7' then '999.5' else price end as price) from given)"
_FIRST_FEED = f"given as ({fixtures.for_oracle(fixtures.FEED)})"
STREAM_CHANGES = (
    f"select product_id, price, pre_score from (with {FEED}, {SCORED} select * from scored) "
    f"union all select product_id, price, pre_score from (with {_FIRST_FEED}, {_DEARER}, {SCORED} select s.* from scored s "
    "join given g on g.product_id = s.product_id where g.price is distinct from s.price)"
)
_BROKEN = (
    "told as (select * replace (description || chr(13) || chr(10) || '\"so\",' || chr(10) || title as description) from feed)"
)

RUN_FIGURES = f"""with {FEED}, {_numbered("product_id")},
firsts as (select cast(substr(product_id, 2) as bigint) as number from numbered where pos % 8 = 0)
select count(*) as batches, count(*) filter (number % 3 <> 0) as valid_at_once,
  count(*) filter (number % 3 = 0) as retried, count(*) filter (number % 6 = 0) as failed_calls,
  count(*) filter (number % 6 = 0) as stubbed
from firsts"""

ORACLES = {
    "clean_feed": f"with raw as ({fixtures.for_oracle(fixtures.RAW_FEED)}) {_cleaned('raw')}",
    "csv_round_trip": _on_feed(_cleaned("feed")),
    "pre_score": _on_scored("select product_id, pre_score, pre_grade from scored"),
    "pre_score_issues": _on_scored(
        "select product_id, pre_issues, pre_missing_attributes from scored"
    ),
    "pre_grade_profile": _on_scored(
        "select pre_grade, count(*) as n_products, min(pre_score) as min_score, "
        "max(pre_score) as max_score, (select min(pre_score) from scored) as feed_min_score, "
        "(select max(pre_score) from scored) as feed_max_score from scored group by pre_grade"
    ),
    "flaw_profile": _on_feed(
        f"select count(*) filter ({_missing('material')}) as missing_material, "
        "count(*) filter (regexp_matches(colour, '[/&]')) as ambiguous_colour, "
        f"count(*) filter (coalesce({_strip('price')}, '') in ('', '0', '0.0')) as missing_price, "
        f"count(*) filter ({_missing('stock_status')}) as missing_stock from feed"
    ),
    "preview": _on_scored(
        "select product_id, title, pre_score as quality_score, pre_grade, pre_issues from scored"
    ),
    "merge_results": _on_merged(f"select {_ENRICHED} from merged"),
    "results_view": _on_merged(
        "select product_id, title, quality_score, grade, issues, improvement_priority, "
        "suggested_title, suggested_keywords from merged"
    ),
    "enriched_export": _on_merged(f"select {_ENRICHED} from merged"),
    "summary_scalars": _on_merged(
        "select *, cast(20 as integer) as n_columns, "
        "cast(format('{:.1f}', cast(100 - average_quality_score as double)) as double) as points_from_perfect, "
        "cast(format('{:.1f}', cast(products_needing_review * cast(0.25 as double) as double)) as double) as hours_saved "
        "from (select count(*) as total_products, "
        "cast(format('{:.1f}', cast(avg(quality_score) as double)) as double) as average_quality_score, "
        "count(*) filter (quality_score < 60) as products_needing_review from merged) m"
    ),
    "grade_distribution": _on_merged(
        "select g.grade, count(m.product_id) as n_products "
        "from (values ('A'), ('B'), ('C'), ('D'), ('F')) g(grade) "
        "left join merged m on m.grade = g.grade group by g.grade"
    ),
    "worst_products": _on_merged(
        "select product_id, title, quality_score, grade, issues, "
        "case when coalesce(issues, '') = '' then 'N/A' else "
        + _strip("split_part(issues, ';', 1)")
        + " end as top_issue from merged order by quality_score, product_id limit 5"
    ),
    "missing_attribute_frequency": _on_merged(
        "select attribute, count(*) as n_products from (select "
        + _strip("unnest(string_split(missing_attributes, ';'))")
        + " as attribute from merged) a "
        "where attribute <> '' and lower(attribute) <> 'none' group by attribute"
    ),
    "title_compare": _on_merged(
        "select product_id, title as original_title, suggested_title as ai_suggested_title, "
        f"quality_score from merged where {_strip('suggested_title')} <> ''"
    ),
    "before_after": _on_merged(_badge_rows()),
    "product_lookup": (
        f"with {FEED}, {RESULTS} "
        "select * from feed where product_id in (select product_id from ai)"
    ),
    "missing_badges": _on_feed(
        "select product_id, array_to_string(gaps, ', ') as missing_fields, "
        "cast(len(gaps) as integer) as n_missing from (select product_id, "
        f"list_filter([{_BADGES}], lambda x: x is not null) as gaps from feed) b"
    ),
    "bands": _on_merged(
        "select product_id, quality_score, grade, "
        "case when quality_score >= 80 then 'high' when quality_score >= 50 then 'mid' "
        "else 'low' end as score_band, "
        "case when quality_score >= 80 then 'high' when quality_score >= 65 then 'mid' "
        "when quality_score >= 50 then 'low-m' else 'low' end as score_class, "
        "case when lower(improvement_priority) in ('high', 'medium') "
        "then lower(improvement_priority) else 'low' end as priority_class, "
        f"{_SHOWN} as issue_list from merged"
    ),
    "batches": _batches("product_id"),
    "batches_by_category": _batches("category nulls last, product_id"),
    "batch_sizes": (
        f"with {FEED}, {_numbered('product_id')} "
        "select cast(pos // 8 as bigint) as batch_id, count(*) as n from numbered group by 1"
    ),
    "batch_requests": (
        f"with {FEED}, {_numbered('product_id')}, "
        "grouped as (select cast(pos // 8 as bigint) as batch_id, count(*) as n, "
        f"'[' || string_agg({_PRODUCT_JSON}, ',' order by pos) || ']' as js "
        "from numbered group by 1) select batch_id, n, "
        f"{_prompt(PROMPT, 'prompt')}, {_prompt(STRICT_PROMPT, 'strict_prompt')} from grouped"
    ),
    "parsed_responses": f"with {ANSWERS}, {PARSED} select batch_id, attempt, n, n_items from checked",
    "validated_batches": f"with {ANSWERS}, {PARSED} select batch_id, attempt, valid from checked",
    "resolved_results": (
        f"with {FEED}, {ANSWERS}, {PARSED}, {RESOLVED} "
        f"select batch_id, attempt, item_no, {', '.join(RESULT_KEYS)} from resolved"
    ),
    "enrich_feed": ENRICHED_BY_MODEL,
    "stream_enriched": ENRICHED_STREAM,
    "run_figures": RUN_FIGURES,
    "csv_split": f"with {FEED}, {_BROKEN} {_cleaned('told')}",
    "ordered_export": ORDERED_EXPORT,
    "stream_headers": _on_scored("select product_id, pre_score, pre_grade, pre_issues from scored"),
    "stream_batches": STREAM_BATCHES,
    "stream_changes": STREAM_CHANGES,
    "rounded_tenths": (
        "select l_orderkey, l_linenumber, "
        "cast(format('{:.1f}', cast(l_extendedprice as double) / 20) as double) as rounded from lineitem"
    ),
    "csv_two_headers": _on_feed(_cleaned("feed")),
    "merge_fan_out": _merged_repeats("select * from given"),
    "merge_first": _merged_repeats(
        "select * from given where product_id is not null "
        "qualify row_number() over (partition by product_id order by seq) = 1"
    ),
    "lookup_first": (
        f"with {_GIVEN} select * from feed where product_id in (select product_id from given) "
        "qualify row_number() over (partition by product_id order by copy) = 1"
    ),
    "first_products": _on_feed("select product_id, title, price from feed order by product_id limit 20"),
    "summary_bundle": _on_merged(_FIGURES),
    "stream_figures": _on_merged(_FIGURES),
    "summary_of_export": _on_merged(
        _FIGURES + " union all select 'band', score_class, cast(count(*) as double) from ("
        "select case when quality_score >= 80 then 'high' when quality_score >= 65 then 'mid' "
        "when quality_score >= 50 then 'low-m' else 'low' end as score_class from merged) b "
        "group by score_class"
    ),
    "stream_scored": _on_scored("select product_id, pre_score, pre_grade, pre_issues from scored"),
}
