"""DuckDB SQL for the corpus queries whose results SQL can express.

Written from the definitions, without the methods: all pairs in place of prefix
joins and bands, every block against every template in place of filters.
"""

from __future__ import annotations

from partcast.llm.chat import LEARNED, TAIL
from partcast.llm.licenses import PERCENT as HELD
from partcast.llm.licenses import PHRASES, TEMPLATES
from partcast.llm.linking import PERCENT
from partcast.llm.ngram_join import K
from partcast.llm.ranked import TOP

SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BY_SPACES, BY_MARKS = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({SMALL.format(f'coalesce({text}, {chr(39) * 2})')}, {pattern})"


def shingles(w: str, k: int = K) -> str:
    """Every k-word shingle of the word list w, the whole list if it is shorter, none if it is empty."""
    return (f"case when len({w}) = 0 then [] when len({w}) < {k} then [array_to_string({w}, ' ')] "
            f"else list_transform(range(1, len({w}) - {k - 2}), lambda i: array_to_string({w}[i:i + {k - 1}], ' ')) end")


#: From member (e, s) on: sizes, links between different sets, and what each set reaches.
REACH = f"""
size as (select e, count(*) as n from member group by e),
common as (select a.e as a, b.e as b, count(*) as c from member a join member b on a.s = b.s and a.e < b.e group by a.e, b.e),
link as (select a, b from common join size x on x.e = a join size y on y.e = b where 100 * c >= {PERCENT} * (x.n + y.n - c)),
tied as (select a, b from link union select b, a from link),
reach(a, b) as (select a, b from tied union select reach.a, tied.b from reach join tied on tied.a = reach.b)"""

NGRAM_JACCARD = f"""
with recursive w as (select doc_id as e, {words("text", BY_SPACES)} as w from documents),
member as (select distinct e, unnest({shingles("w")}) as s from w),{REACH},
least as (select a, min(b) as b from reach group by a)
select w.e as doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(least(least.b, w.e), w.e) as component_id
from w left join size on size.e = w.e left join least on least.a = w.e"""

_places = ", ".join(
    f"struct_pack(label := '{label}', found := list_filter(range(0, len(w) - {len(p.split()) - 1}), "
    f"lambda i: w[i + 1:i + {len(p.split())}] = {p.split()}))" for p, label in PHRASES.items())
_templates = ", ".join(f"({list(dict.fromkeys(t.split()))}, '{label}')" for t, label in TEMPLATES.items())

LICENSES = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as blocks, {words("text", BY_MARKS)} as w from documents),
phrase as (select doc_id, unnest([{_places}], recursive := true) from d),
place as (select doc_id, label, unnest(found) as p from phrase),
base as (select doc_id, count(*) as n, min(p) as first, max(p) as last, list_distinct(list(label)) as labels from place group by doc_id),
template(t, label) as (values {_templates}),
block as (select doc_id, list_distinct({words("b", BY_MARKS)}) as b from (select doc_id, unnest(blocks) as b from d)),
held as (select doc_id, label, len(list_intersect(b, t)) / len(t) as share
         from block, template where len(list_intersect(b, t)) * 100 >= len(t) * {HELD}),
more as (select doc_id, max(share) as share, list_distinct(list(label)) as labels from held group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base, first as first_word, last as last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') as labels,
       cast(case when n > 0 then 1 else coalesce(share, 0) end as double) as score
from d left join base on base.doc_id = d.doc_id left join more on more.doc_id = d.doc_id"""

RANKED = f"""
with d as (select row_number() over () as r, doc_id, {words("text", BY_MARKS)} as w from documents),
doc as (select r, doc_id, cast(len(w) as bigint) as n from d where len(w) > 0),
total as (select cast(count(*) as bigint) as docs, cast(coalesce(sum(n), 0) as bigint) as terms from doc),
held as (select r, t, cast(count(*) as bigint) as tf from (select r, unnest(w) as t from d) group by r, t),
freq as (select t, count(*) as df from held group by t),
asked as (select i, t, count(*) as times from (select row_number() over () as i, unnest({words("text", BY_MARKS)}) as t from benchmark) group by i, t),
item as (select row_number() over () as i, item_id from benchmark),
met as (select i, r, cast(sum(times * cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
                 * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) as bigint) as score
        from asked join held using (t) join freq using (t) join doc using (r), total group by i, r),
best as (select i, r, score, row_number() over (partition by i order by score desc, doc_id nulls last) as rank
         from met join doc using (r) where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from best join item using (i) join doc using (r) where rank <= {TOP}"""

WARC = """
with p as (select page_id, coalesce(html, '') as h, min(page_id) over (partition by coalesce(html, '')) as first from pages),
five as (select page_id, h, first, list_transform(range(0, 8),
         lambda i: cast('0x' || substr(sha1(h), 5 * i + 1, 5) as bigint)) as x from p)
select page_id, cast(strlen(h) as bigint) as payload_bytes,
       array_to_string(list_transform(x, lambda v: array_to_string(list_transform([15, 10, 5, 0],
           lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31) + 1, 1)), '')), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from five"""


def _escaped(text: str, marks: str) -> str:
    return rf"2 * length({text}) - length(regexp_replace({text}, '[{marks}]', '', 'g'))"


def chat(hard: str) -> str:
    fixed = len("### : ") + len(TAIL)
    return rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '{hard}'), (-7, 1, '{LEARNED}', '{hard}'))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = '{LEARNED}'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = '{LEARNED}'), '')) as loss_sha256,
       cast(sum({fixed} + {_escaped('role', r'\\#<:')} + {_escaped('text', r'\\#<')}) as bigint) as formatted_chars
from t group by conv_id"""
