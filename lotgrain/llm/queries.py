"""The registered queries of this package: each operator over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrain.llm import bpe, chosen_path, conversations, fm_index, hmm, html_text, licenses, merkle, mtree, quality, toxicity, warc, windows
from lotgrain.llm.rows import spaced_words, with_text_columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents"))


@query
def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"), keep=["page_id", "url"])


@query
def op3_hmm_score(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score_held_out(_table(spark, folder, "documents"))


@query
def op4_mtree_topk(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.top_k(_table(spark, folder, "embeddings"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_table(spark, folder, "documents"), bpe.load(vocabulary()), keep=["doc_id"])


def _kept_digest():
    def work(texts, part):
        n_words, n_removed, digests = [], [], []
        for text, spans in zip(texts, part.column("spans").to_pylist(), strict=True):
            words = spaced_words(text)
            n_words.append(len(words))
            for span in reversed(spans or []):
                del words[span["start"] : span["end"]]
            n_removed.append(n_words[-1] - len(words))
            digests.append(sha256(b" ".join(words)).hexdigest())
        return [n_words, n_removed, digests]

    return work


@query
def op6_substrings(spark: SparkSession, folder: str) -> DataFrame:
    docs = windows.with_spans(_table(spark, folder, "documents").select("doc_id", "text"))
    fields = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]
    return with_text_columns(docs, fields, _kept_digest, keep=["doc_id"], read=["spans"])


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_held_out(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query
def op8_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return chosen_path.near_duplicates(docs, shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    found = fm_index.scan(docs, benchmark, keep=["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_held_out(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.prove(_table(spark, folder, "documents"))


@query
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.convert_pages(_table(spark, folder, "pages"))[1]


@query
def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(_table(spark, folder, "conversations"))


# Words of a text as both scans of license phrases and of benchmark items take them.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op9_decontamination"] = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark where text is not null),
iw as (
    select distinct item_id, least(len(w), 10) as k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') as win
    from (select item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as p from i where len(w) > 0)
),
sizes as (select distinct k from iw),
dw as (
    select r, k, p, array_to_string(w[p:p + k - 1], ' ') as win
    from (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) as p from d, sizes where len(w) >= k)
),
hits as (select distinct r, p, iw.k as k, item_id from dw join iw on dw.k = iw.k and dw.win = iw.win),
cover as (select r, count(distinct q) as n_hit from (select r, unnest(generate_series(p, p + k - 1)) as q from hits) group by r),
named as (
    select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items
    from hits group by r
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cover using (r) left join named using (r)
"""

SQL["op6_substrings"] = r"""
with d as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
win as (
    select r, p, array_to_string(w[p:p + 34], ' ') as s
    from (select r, w, unnest(generate_series(1, len(w) - 34)) as p from d where len(w) >= 35)
),
twice as (select s from win group by s having count(*) > 1),
gone as (select distinct r, unnest(generate_series(p, p + 34)) as q from win where s in (select s from twice)),
words as (select r, unnest(w) as word, unnest(generate_series(1, len(w))) as q from d),
kept as (
    select r, string_agg(word, ' ' order by q) as t
    from words anti join gone using (r, q) group by r
),
n as (select r, count(*) as n_removed from gone group by r)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r) left join n using (r)
"""

SQL["op4_mtree_topk"] = """
with e as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0
),
s as (
    select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v)::bigint as score
    from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

SQL["op8_chosen_path"] = r"""
with recursive d as (
    select row_number() over () as r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
),
s as (
    select distinct r, array_to_string(w[p:p + 2], ' ') as g
    from (select r, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as p from d where len(w) > 0)
),
n as (select r, count(*) as n from s group by r),
i as (select x.r as a, y.r as b, count(*) as i from s x join s y on x.g = y.g and x.r <> y.r group by all),
link as (
    select a, b from i join n na on na.r = a join n nb on nb.r = b where 100 * i >= 85 * (na.n + nb.n - i)
),
reach as (
    select distinct a as r, a as t from link
    union
    select reach.r, link.b from reach join link on reach.t = link.a
),
c as (select reach.r, min(d.doc_id) as component_id from reach join d on d.r = reach.t group by reach.r)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept
from d left join n using (r) left join c using (r)
"""


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text: each byte, then eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {steps}), lambda c, x: {step}), 4294967295)"


def _leaf(text: str) -> str:
    values = [f"{c}::varchar" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


def _levels(name: str, start: str) -> str:
    """SQL for all nodes (tree, lvl, pos, n, h) of trees whose bottom nodes ``start`` selects."""
    return f"""{name} as (
    select tree, 0 as lvl, pos, n, h from ({start})
    union all
    select tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from {name} where n > 1 group by tree, lvl, pos // 3, n
)"""


def _folds(name: str, start: str) -> str:
    """SQL for (r, tree, lvl, pos, cur, proof): what is folded from bottom nodes upwards, level by level."""
    return f"""{name} as (
    select r, tree, 0 as lvl, pos, cur, proof from ({start})
    union all
    select r, f.tree, f.lvl + 1, f.pos // 3, sha256(s.l || cur || s.r_), proof || s.l || s.r_
    from {name} f join sib s on f.tree = s.tree and f.lvl = s.lvl and f.pos = s.pos
)"""


SQL["op11_merkle"] = f"""
with recursive d as (
    select row_number() over () as r, doc_id, coalesce('=' || source, '-') as tree, {_leaf("text")} as leaf,
        case when {_crc32("doc_id::varchar")} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as checked
    from documents
),
p as (
    select *, row_number() over (partition by tree order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by tree) as n from d
),
{_levels("up", "select tree, pos, n, leaf as h from p")},
subroots as (select tree as name, row_number() over (order by tree) - 1 as pos, count(*) over () as n, h from up where n = 1),
{_levels("top", "select '' as tree, pos, n, h from subroots")},
nodes as (select * from up union all select * from top),
sib as (
    select a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as l,
        coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as r_
    from nodes a join nodes b on a.tree = b.tree and a.lvl = b.lvl and a.pos // 3 = b.pos // 3 where a.n > 1 group by a.tree, a.lvl, a.pos
),
{_folds("low", "select r, tree, pos, checked as cur, '' as proof from p")},
ends as (select f.*, s.pos as place from low f join subroots s on s.name = f.tree where f.lvl = (select max(lvl) from up where up.tree = f.tree)),
{_folds("high", "select r, '' as tree, place as pos, cur, proof from ends")},
done as (select * from high where lvl = (select max(lvl) from top)),
root as (select h as root from top where n = 1)
select p.doc_id, leaf, s.h as subroot, root, sha256(proof) as proof_sha256, cur as folded_root, cur = root as verified
from p join done using (r) join subroots s on s.name = p.tree cross join root
"""

SQL["op12_warc"] = """
with p as (select row_number() over () as r, page_id, coalesce(html, '') as t from pages),
f as (select t, min(page_id) as first from p group by t),
o as (select p.*, first, row_number() over (partition by t order by page_id, r) as nth, sha1(t) as h from p join f using (t)),
digits as (select *, list_transform(string_split(h, ''), lambda x: instr('0123456789abcdef', x) - 1) as x from o),
groups as (
    select *, list_transform(range(0, 8), lambda i: x[5 * i + 1] * 65536 + x[5 * i + 2] * 4096 + x[5 * i + 3] * 256 + x[5 * i + 4] * 16 + x[5 * i + 5]) as g
    from digits
)
select page_id, octet_length(encode(t))::bigint as payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31)::int + 1, 1)), 'string_agg', '')
        as payload_digest,
    case when nth = 1 then 'response' else 'revisit' end as record_type, case when nth > 1 then first end as refers_to
from groups
"""

_SPACE = r"[\x20\x09-\x0D]"

SQL["op13_conversations"] = rf"""
with recursive given as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key,
        coalesce('=' || conv_id::varchar, '-') as conv
    from conversations
),
lots as (select *, {_crc32("key")} % 20 as lot from given),
hurt as (
    select conv, turn, case when lot = 4 then 'user' else role end as role,
        case when lot = 1 then '' when lot = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(0, case when lot = 3 then 2 else 1 end)) as copy
    from lots where lot <> 0
),
rows as (
    select *, row_number() over (partition by conv order by turn nulls first, role, sha256(length(role) || ':' || role || text), copy) as i,
        count(*) over (partition by conv) as n, left(role, 1) as initial
    from hurt
),
seen as (select *, row_number() over (partition by conv, role, text order by i) as nth, lag(initial) over (partition by conv order by i) as before from rows),
faults as (
    select *, case when not regexp_matches(text, '[^ 	-
]') then 'b' when nth > 1 then 'd'
        when not regexp_matches(text, '[.!?][ 	-
]*$') then 't' else '' end as fault
    from seen
),
ins as (select * from (values
    ('', 0, '', ''), ('', 1, 'u', 'user:' || chr(10)), ('', 2, 'a', 'user:' || chr(10) || 'assistant:' || chr(10)),
    ('s', 0, 's', ''), ('s', 1, 'u', 'user:' || chr(10)), ('s', 2, 'a', 'user:' || chr(10) || 'assistant:' || chr(10)),
    ('u', 0, 'u', ''), ('u', 1, 'a', 'assistant:' || chr(10)), ('a', 0, 'a', ''), ('a', 1, 'u', 'user:' || chr(10))) as t(st, k, mid, made)),
ops as (select * from (values
    ('', 'D', '', 3), ('s', 'D', 's', 3), ('u', 'D', 'u', 3), ('a', 'D', 'a', 3),
    ('', 'K', 's', 0), ('', 'K', 'u', 0), ('s', 'K', 'u', 0), ('u', 'K', 'a', 0), ('a', 'K', 'u', 0),
    ('', 'R', 'u', 2), ('s', 'R', 'u', 2), ('u', 'R', 'a', 2), ('a', 'R', 'u', 2)) as t(mid, op, nxt, price)),
way as (
    select distinct conv, n, 1::bigint as i, '' as st, {{'c': 0::bigint, 'a': '', 'o': ''}} as b from rows
    union all
    select w.conv, w.n, w.i + 1, nxt, min({{
        'c': w.b.c + 2 * k + price + case when op <> 'D' and fault = 't' then 1 else 0 end,
        'a': w.b.a || repeat('I', k) || op,
        'o': w.b.o || made || case op when 'D' then '' when 'K' then role || ':' || text || chr(10)
            else case nxt when 'u' then 'user' else 'assistant' end || ':' || text || chr(10) end}})
    from way w join faults f on f.conv = w.conv and f.i = w.i join ins on ins.st = w.st join ops on ops.mid = ins.mid
    where (op = 'D' or fault not in ('b', 'd')) and (op <> 'K' or nxt = initial)
    group by w.conv, w.n, w.i, nxt
),
best as (
    select conv, min({{'c': w.b.c + 2 * k, 'a': w.b.a || repeat('I', k), 'o': w.b.o || made}}) as b
    from way w join ins on ins.st = w.st where w.i = w.n + 1 and mid in ('', 'a') and (mid = 'a' or k = 0) group by conv
),
stats as (
    select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
        count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
        count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
    from faults group by conv
)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit,
    sha256(coalesce(left(b.o, greatest(length(b.o) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id, conv from given) left join stats using (conv) left join best using (conv)
"""
