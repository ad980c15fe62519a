"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from corpusmill.llm import licences, linededup, quality


def _list(items) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in items)


def quality_ctes(source: str) -> str:
    """CTEs ending in ``judged``: (rid, doc_id, counts, base_failed, kept) for each row of ``source``."""
    tests = []
    for rule in quality.RULES:
        if rule.low is not None:
            tests.append(f"{rule.numerator} + {rule.slack} >= {rule.low!r}::double * {rule.denominator}")
        if rule.high is not None:
            tests.append(f"{rule.numerator} <= {rule.high!r}::double * {rule.denominator}")
    stop = _list(sorted({form for w in quality.STOP_WORDS for form in (w, w.capitalize(), w.upper())}))
    return f"""
q_rows as (select row_number() over () rid, doc_id, coalesce(text, '') t from {source}),
q_lists as (select rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) ls from q_rows),
q_words as (select rid, unnest(ws) w, unnest(range(len(ws))) pos from q_lists),
q_windows as (select rid, pos, case when lead(pos, 4) over o is not null then
  w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o end g
  from q_words window o as (partition by rid order by pos)),
q_twice as (select rid, pos from (select *, count(*) over (partition by rid, g) n from q_windows where g is not null) where n > 1),
q_repeat as (select rid, count(distinct pos + k) n from q_twice, (select unnest(range(5)) k) group by rid),
q_stop as (select rid, count(*) n from q_words where w in ({stop}) group by rid),
q_counts as (select q_rows.rid, doc_id, len(ws) n_words,
  coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  len(ls) n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
  coalesce(q_repeat.n, 0) n_repeat_words, coalesce(q_stop.n, 0) n_stop_words
  from q_rows join q_lists using (rid) left join q_repeat using (rid) left join q_stop using (rid)),
q_base as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words base_failed from q_counts),
judged as (select *, not base_failed and {" and ".join(tests)} kept from q_base)"""


def hits_ctes(source: str) -> str:
    """CTEs ending in ``d_found``: (rid, doc_id, n_words, n_hit, items) for each row of ``source``."""
    cut = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
d_rows as (select row_number() over () rid, doc_id, {cut.format("text")} ws from {source}),
d_items as (select item_id, {cut.format("text")} ws from benchmark),
d_windows as (select distinct item_id, list_slice(ws, i, i + least(10, len(ws)) - 1) g from
  (select *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) i from d_items where len(ws) > 0)),
d_words as (select rid, unnest(ws) w, unnest(range(1, len(ws) + 1)) pos from d_rows),
d_hits as (select distinct d_words.rid, pos, len(g) n, item_id from d_windows join d_words on w = g[1]
  join d_rows on d_rows.rid = d_words.rid and list_slice(d_rows.ws, pos, pos + len(g) - 1) = g),
d_covered as (select rid, count(distinct p) n_hit from (select rid, unnest(range(pos, pos + n)) p from d_hits) group by rid),
d_named as (select rid, list(i order by i) items from (select distinct rid, coalesce(item_id::varchar, '') i from d_hits) group by rid),
d_found as (select d_rows.rid, doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(items, []) items
  from d_rows left join d_covered using (rid) left join d_named using (rid))"""


def _licence_sql() -> str:
    table = ", ".join(f"('{sentence}', '{name}')" for name, sentence in licences.SENTENCES.items())
    named = ", ".join(
        f"case when regexp_matches(row, '{'|'.join(licences.rule_pattern(s) for s in ways)}') then '{name}' end"
        for name, ways in licences.RULES.items()
    )
    return f"""with l_rows as (select row_number() over () rid, doc_id,
  regexp_replace(lower(coalesce(text, '')), '[.!?:;]+([ \\x09-\\x0D]|$)', chr(10), 'g') t from documents),
l_cut as (select rid, doc_id, string_split(regexp_replace(regexp_replace(t, '[\\x0D\\x0A]+', chr(10), 'g'), '[^a-z0-9\\x0A]+', ' ', 'g'), chr(10)) ss from l_rows),
l_each as (select rid, trim(unnest(ss)) s, unnest(range(len(ss))) pos from l_cut),
l_ids as (select rid, list(name order by pos) ids from l_each join (values {table}) k(sentence, name) on s = sentence group by rid),
l_all as (select doc_id, coalesce(ids, []) ids, ' ' || array_to_string(coalesce(ids, []), ' ') || ' ' row from l_cut left join l_ids using (rid))
select doc_id, len(ids) n_known, array_to_string(ids, ',') sentence_ids,
  array_to_string(list_filter([{named}], lambda x: x is not null), ',') licences from l_all"""


LINES_SQL = f"""with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select r, doc_id, unnest(ls) line, unnest(range(len(ls))) pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '{linededup.UPPER}', '{linededup.LOWER}') key from l),
s as (select key, max(doc_id) top from k where length(key) >= {linededup.MIN_POINTS} group by key
  having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= {linededup.MIN_DOCUMENTS}),
j as (select r, doc_id, line, pos, s.key is not null and doc_id is distinct from top gone from k left join s using (key))
select any_value(doc_id) doc_id, count(*) n_lines, count(*) filter (gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256 from j group by r"""


def _repair_sql() -> str:
    """The same edits by a recursive query that carries whole audits and texts per state and turn."""

    def way(state: str, cost: str, edit: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}}"

    def least(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    def used(state: str, initial: str, name: str) -> str:
        """The row takes the place of ``initial`` after ``state``."""
        kept = way(state, "cut", "K", "chr(10) || role || ':' || text")
        changed = way(state, "2 + cut", "R", f"chr(10) || '{name}:' || text")
        return f"case when not free then no when ini = '{initial}' then {kept} else {changed} end"

    def inserted(state: str, name: str) -> str:
        return way(state, "2", "I", f"chr(10) || '{name}:'")

    start = "{'c': 0::bigint, 'a': '', 't': ''}"
    none = "{'c': 1000000000000::bigint, 'a': '', 't': ''}"
    system = f"case when free and ini = 's' then {way('b', 'cut', 'K', "chr(10) || role || ':' || text")} else no end"
    return f"""with recursive t as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
  coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
w as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ord(c)::bigint)),
  lambda h, x: list_reduce(list_prepend(xor(h, x), range(8)), lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)),
  4294967295::bigint) % 20 way from t),
d as (select conv_id, turn, case when way = 4 then 'user' else role end as role,
  case way when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(case when way = 3 then [1, 2] else [1] end) from w where way <> 0),
o as (select *, left(role, 1) ini, row_number() over (partition by conv_id order by turn nulls first, role, text) pos from d),
f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when row_number() over (partition by conv_id, role, text order by pos) > 1 then 2
  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end fault,
  lag(ini) over (partition by conv_id order by pos) || ini pair from o),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 1) blank,
  count(*) filter (fault = 2) duplicate, count(*) filter (fault = 3) truncated,
  count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) illegal, max(pos) last from f group by conv_id),
v(conv_id, pos, b, s, u, a) as (
  select conv_id, 0::bigint, {start}, {none}, {inserted("q", "user").replace("q.c", "0").replace("q.a", "''").replace("q.t", "''")},
    {{'c': 4::bigint, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} from n
  union all
  select conv_id, pos, b, s, u, {least("a", inserted("u", "assistant"))} from (
    select conv_id, pos, b, s, {least("u", inserted("b", "user"), inserted("s", "user"), inserted("a", "user"))} u, a from (
      select conv_id, pos, {way("b", "3", "D")} b, {least(way("s", "3", "D"), system)} s,
        {least(way("u", "3", "D"), used("b", "u", "user"), used("s", "u", "user"), used("a", "u", "user"))} u,
        {least(way("a", "3", "D"), used("u", "a", "assistant"))} a
      from (select f.*, b, s, u, a, fault not in (1, 2) free, (fault = 3)::bigint cut, {none} no
        from v join f on f.conv_id is not distinct from v.conv_id and f.pos = v.pos + 1))) ),
e as (select n.*, {least("b", "a")} best from v join n on n.conv_id is not distinct from v.conv_id and v.pos = n.last)
select i.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(substr(best.t, 2), '')) repaired_sha256
from (select distinct conv_id from conversations) i left join e on i.conv_id is not distinct from e.conv_id"""


NEGATIVES_SQL = """with e as (select row_number() over () r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings where vec_id is not null and label is not null
  and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
a as (select min(r) r, vec_id, l, v from e where vec_id % 100 = 0 group by vec_id, l, v),
s as (select a.r, a.vec_id anchor_id, e.r place, e.vec_id id, a.l = e.l same,
  coalesce(list_sum(list_transform(range(1, least(len(a.v), len(e.v)) + 1), lambda i: a.v[i] * e.v[i])), 0)::bigint score from a join e on a.vec_id <> e.vec_id),
p as (select * from s where same qualify row_number() over (partition by r order by score desc, id) <= 5),
n as (select p.anchor_id, p.id positive_id, row_number() over (partition by p.r, p.place order by s.score desc, s.id)::int as rank, s.id negative_id,
  p.score positive_score, s.score negative_score from p join s on s.r = p.r and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select * from n where rank <= 5"""


def oracles() -> dict[str, str]:
    return {
        "op12_rtree_negatives": NEGATIVES_SQL,
        "op11_survivor_repair": _repair_sql(),
        "op13_line_bitmaps": LINES_SQL,
        "op3_sentence_licences": _licence_sql(),
        "op4_arc_to_warc": """with p as (select page_id, encode(coalesce(html, '')) b, row_number() over () r from pages),
d as (select page_id, octet_length(b)::bigint payload_bytes, sha1(b) payload_digest, r from p),
k as (select *, first_value(page_id) over (partition by payload_digest order by page_id desc nulls last, r) top,
  row_number() over (partition by payload_digest order by page_id desc nulls last, r) place from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and place > 1 then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 1000 and place > 1 then top end refers_to from k""",
        "op9_positional_index": f"""with {hits_ctes("documents")}
select doc_id, n_words, n_hit, len(items) n_items, sha256(array_to_string(items, ',')) items_sha256, n_hit > 0 contaminated from d_found""",
        "op10_quality_rules": f"""with {quality_ctes("documents")}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from judged""",
    }
