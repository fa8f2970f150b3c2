"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from shelfgauge.llm.quality_rules import (
    END,
    ENTRY_WORDS,
    LEAST_WORDS,
    MENU_LINE,
    MOST_LOST,
    MOST_REPEATED,
    NOTICE_WORDS,
    NOTICES,
    SHORT,
    SYMBOLS,
    WINDOW,
)


def _sql(pattern: str) -> str:
    """A pattern as a string constant."""
    return "'" + pattern.replace("'", "''") + "'"


OP1 = r"""
with keyed as (
    select doc_id, length(coalesce(text, '')) as size,
        sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\x0c\r]', '', 'g')) as text_sha256
    from documents
), ranked as (
    select *,
        first_value(doc_id) over (
            partition by text_sha256 order by size desc, doc_id nulls last
        ) as keep_id,
        count(*) over (partition by text_sha256) as group_size,
        row_number() over (
            partition by text_sha256 order by size desc, doc_id nulls last
        ) as place
    from keyed
)
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256
from ranked
"""

# Repeats are counted over positions of five-word windows; a word is repeated if a window
# over it is. Lines are judged as in the operator: symbols, shouts, ends, menus, notices.
# A menu's entries are what bars cut apart, and hyphens that are words of their own.
OP3 = rf"""
with texts as (
    select doc_id, coalesce(text, '') as text, row_number() over () as n from documents
), words as (
    select n, regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+') as w from texts
), windows as (
    select n, unnest(range(1, greatest(1, len(w) - {WINDOW - 2}))) as pos, w from words
), hashed as (
    select n, pos, w[pos:pos + {WINDOW - 1}] as five from windows
), again as (
    select n, pos from hashed qualify count(*) over (partition by n, five) > 1
), repeats as (
    select n, count(distinct place) as n_repeat_words
    from (select n, unnest(range(pos, pos + {WINDOW})) as place from again)
    group by n
), lines as (
    select n, pos, line, len(regexp_extract_all(line, '[^ \t\n\x0b\x0c\r]+')) as own
    from (
        select n, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
        from texts
    )
), seen as (
    select *, row_number() over (partition by n, line order by pos) > 1 as repeated,
        own <= {NOTICE_WORDS} and (
            {" or ".join(f"contains(lower(line), {_sql(notice)})" for notice in NOTICES)}
        ) as notice
    from lines where own > 0
), judged as (
    select *, repeated or notice
        or 4 * len(regexp_extract_all(line, {_sql("[" + SYMBOLS + "]")})) > own
        or 2 * (length(line) - length(replace(line, '!', ''))) > own
        or (own < {SHORT} and not regexp_matches(line, {_sql(END)}))
        or (regexp_matches(line, {_sql(MENU_LINE)}) and {ENTRY_WORDS} >= list_max(list_transform(
            regexp_split_to_array(
                array_to_string(list_transform(
                    regexp_extract_all(line, '[^ \t\n\x0b\x0c\r]+'),
                    lambda word: case when word = '-' then '|' else word end), ' '),
                '[|>»•·/]'),
            lambda entry: len(regexp_extract_all(entry, '[^ \t\n\x0b\x0c\r]+'))))) as fails
    from seen
), lost as (
    select n, sum(repeated::int) as n_dup_lines,
        sum(case when fails and not notice then own else 0 end) as n_lost_words,
        sum(case when fails then 0 else own end) as stay
    from judged group by n
), counted as (
    select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        len(regexp_extract_all(text, {_sql("[" + SYMBOLS + "]")})) as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words,
        coalesce(n_lost_words, 0)::bigint as n_lost_words, coalesce(stay, 0) as stay
    from texts join words using (n) left join repeats using (n) left join lost using (n)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words,
    n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
    not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words)
        and (stay > 0 or n_lost_words = 0) and 100 * n_lost_words <= {MOST_LOST} * n_words as kept
from counted
"""

# Base32 of the SHA-1: each five bits of the digest pick a letter.
OP4 = """
with paid as (
    select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes,
        sha1(coalesce(html, '')) as hex,
        max(page_id) over (partition by coalesce(html, '')) as last
    from pages
), bits as (
    select *, array_to_string(list_transform(
        range(1, 41), lambda i: right(bin(16 + strpos('0123456789abcdef', hex[i]) - 1), 4)), '') as b
    from paid
)
select page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1
            + 16 * b[5 * i + 1]::int + 8 * b[5 * i + 2]::int + 4 * b[5 * i + 3]::int
            + 2 * b[5 * i + 4]::int + b[5 * i + 5]::int]), '') as payload_digest,
    case when page_id = last then 'response' else 'revisit' end as record_type,
    case when page_id = last then null else last end as refers_to
from bits
"""

#: The checksum of a text column, bit by bit.
_CRC32 = """xor(list_reduce(
    [4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
        lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))
), 4294967295::BIGINT)"""

OP11 = f"""
with own as (
    select conv_id as c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first) as turns
    from conversations
    where conv_id is not null
    group by conv_id
), heads as (
    select c, turns, c - c % 20 as base, {_CRC32.format(text="c::varchar")} % 4 as h
    from own
), rebuilt as (
    select a.c, coalesce(b.turns, [])[1:a.h] || a.turns[a.h + 1:] as turns
    from heads a left join own b on b.c = a.base
), prefixes as (
    select c, d, len(turns) as size, md5(to_json(turns[1:d])::varchar) as node,
        md5(to_json(turns[1:d - 1])::varchar) as up,
        case when d = 0 then 0 else len(regexp_extract_all(turns[d].text, '[^ \t\n\x0b\x0c\r]+')) end as words
    from (select c, turns, unnest(range(len(turns) + 1)) as d from rebuilt)
), nodes as (
    select node, d, min(c) as conv_id, count(*) as n_convs, min(up) as up, min(words) as words,
        coalesce(string_agg(c::varchar, ',' order by c) filter (where d = size), '') as ends
    from prefixes
    group by node, d
), kids as (
    select up as node, d - 1 as d, count(*) as n_children from nodes where d > 0 group by up, d - 1
), full_nodes as (
    select n.*, coalesce(k.n_children, 0) as n_children
    from nodes n left join kids k on k.node = n.node and k.d = n.d
), below as (
    select p.node, p.d, sum((n.n_children = 0)::bigint) as n_leaves, sum((n.n_convs - 1) * n.words) as saved
    from full_nodes n join prefixes p on p.c = n.conv_id and p.d <= n.d
    group by p.node, p.d
)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, n.n_children::bigint as n_children,
    b.n_leaves::bigint as n_leaves, b.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from full_nodes n
join below b on b.node = n.node and b.d = n.d
left join nodes u on n.d > 0 and u.node = n.up and u.d = n.d - 1
"""

OP12 = """
with texts as (
    select doc_id, row_number() over (order by doc_id) as n,
        regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\x0c\r]+') as words
    from documents
), windows as (
    select n, pos, md5(array_to_string(words[pos:pos + 19], ' ')) as words
    from (select n, words, unnest(range(1, len(words) - 18)) as pos from texts where len(words) >= 20)
), later as (
    select n, pos from windows qualify row_number() over (partition by words order by n, pos) > 1
), covered as (
    select distinct n, pos + step as pos from (select n, pos, unnest(range(20)) as step from later)
), kept as (
    select n, string_agg(word, ' ' order by pos) as text
    from (select n, unnest(words) as word, generate_subscripts(words, 1)::bigint as pos from texts)
    anti join covered using (n, pos)
    group by n
), removed as (
    select n, count(*) as n_removed from covered group by n
)
select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
    sha256(coalesce(text, '')) as kept_sha256
from texts left join kept using (n) left join removed using (n)
"""

# Near words share a form with one character masked, or one is the other without one.
OP13 = """
with runs as (
    select doc_id::varchar || ':' as id, run, count(*) as n
    from (
        select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]{7,}')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
        from documents
    )
    group by all
), bytes as (
    select run, n, hex(coalesce(id, ':') || run) as h from runs
), summed as (
    select run, n, xor(list_reduce(
        [4294967295::BIGINT] || list_transform(range(1, len(h), 2), lambda i:
            (16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT),
        lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
            lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))
    ), 4294967295::BIGINT) as crc
    from bytes
), variants as (
    select n, case when crc % 31 = 0
        then left(run, (crc % length(run))::int) || substr(run, (crc % length(run))::int + 2) else run end as word
    from summed
), words as (
    select word, sum(n)::bigint as n from variants where length(word) >= 7 group by word having sum(n) >= 2
), cuts as (
    select word, left(word, i::int) as a, substr(word, i::int + 2) as b
    from (select word, unnest(range(length(word))) as i from words)
), pairs as (
    select c.word, d.word as other from cuts c join cuts d on c.a = d.a and c.b = d.b and c.word <> d.word
    union select c.word, w.word from cuts c join words w on w.word = c.a || c.b
    union select w.word, c.word from cuts c join words w on w.word = c.a || c.b
), near as (
    select p.word, count(*) as n_near, first(p.other order by w.n desc, p.other) as best,
        max(w.n) as best_n
    from pairs p join words w on w.word = p.other
    group by p.word
), forms as (
    select word, n, coalesce(n_near, 0)::bigint as n_near,
        case when best_n >= 10 * n then best end as form, case when best_n >= 10 * n then best_n end as form_n
    from words left join near using (word)
), steps as (
    with recursive up(word, root) as (
        select word, word from forms
        union all
        select u.word, f.form from up u join forms f on f.word = u.root where f.form is not null
    )
    select u.word, u.root from up u join forms f on f.word = u.root where f.form is null
)
select word, form, root, n, n_near, form_n from forms join steps using (word)
"""

ORACLES = {
    "op1_exact_dedup": OP1,
    "op3_quality_rules": OP3,
    "op4_warc": OP4,
    "op11_prefix_trie": OP11,
    "op12_substring_dedup": OP12,
    "op13_spelling": OP13,
}
