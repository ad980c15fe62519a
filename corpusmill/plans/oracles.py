"""The registered queries as plain SQL over the driver tables, for checking."""

from __future__ import annotations

from corpusmill.operators.scorer import BIGRAM_WEIGHT
from corpusmill.plans.queries import (
    ACCUMULATION,
    BATCH,
    DIGITS,
    LENGTH,
    LIMIT,
    LR,
    MAX_LINE_BYTES,
    MAX_PROMPT,
    SAMPLE_LINES,
    SHARD,
    STREAM_LIMIT,
    VOCAB,
    WORKERS,
)

# Common table expressions, each named after its key and listed after those it reads.
_PARTS = {
    "f": r"select doc_id, trim(text, E' \t\n\r\f\x0b') t from documents where text is not null",
    "a": r"""select doc_id, t, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) n_words
        from f where len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) >= 32""",
    "k": "select doc_id, t, n_words, row_number() over (order by doc_id) - 1 ord from a",
    "d": """select doc_id, ord, t, case when ord % 200 = 0 then 'val' else 'train' end split,
        octet_length(encode(t)) + 2 n from k""",
    "p": "select *, (sum(n) over (partition by split order by ord) - n)::bigint st from d",
    "ids": """select doc_id, split, n, st, list_concat([2], list_transform(
        regexp_extract_all(hex(encode(t)), '..'), lambda h: 4 + ('0x' || h)::int), [3]) ids from p""",
    "tok": """select split, st + i off, id from (
        select split, st, unnest(range(n)) i, unnest(ids) id from ids)""",
    "sh": f"""select split, off // {SHARD} shard, count(*) tokens,
        count(*) filter (id = 3) eos_count,
        sha256(unhex(string_agg(printf('%02x%02x', id % 256, id // 256), '' order by off))) sha256
        from tok group by all""",
    "bp": f"""select *, (sum(n - 1) over (partition by split order by ord) - n + 1)::bigint bs
        from d where ord < {STREAM_LIMIT}""",
    "bx": """select split, bs + i off, id from (select split, bs, unnest(range(n - 1)) i, unnest(list_concat(list_transform(
        regexp_extract_all(hex(encode(t)), '..'), lambda h: 4 + ('0x' || h)::int), [3])) id from bp)""",
    "bare": f"""select split, off // {SHARD} shard, count(*) tokens, count(*) filter (id = 3) eos_count,
        sha256(unhex(string_agg(printf('%02x%02x', id % 256, id // 256), '' order by off))) sha256
        from bx group by all""",
    "st": f"select split, (off // {SHARD})::int shard, count(*) tokens from tok group by all",
    "pos": f"select split, off // {SHARD} shard, off % {SHARD} o, id from tok",
    "w": f"""select split, shard, o // {LENGTH} win, o, id from pos
        union all select split, shard, o // {LENGTH} - 1, o, id from pos where o % {LENGTH} = 0 and o > 0""",
    "win": f"""select split, shard, win, list(id order by o) ids from w
        group by all having count(*) = {LENGTH} + 1""",
    "pairs": f"""select split, shard, win, unnest(ids[1:{LENGTH}]) x, unnest(ids[2:]) y from win""",
    "bi": "select x, y, count(*) n from pairs where split = 'train' group by all",
    "ux": "select x, sum(n) n_x from bi group by x",
    "uy": "select y, sum(n) n_y from bi group by y",
    "un": "select sum(n) n_all from bi",
    "nll": f"""select pairs.*, -ln({BIGRAM_WEIGHT} * coalesce(n / n_x, 0)
        + {1 - BIGRAM_WEIGHT} * (coalesce(n_y, 0) + 1) / (n_all + 260)) nll
        from pairs left join bi using (x, y) left join ux using (x) left join uy using (y), un""",
    "nw": f"select split, shard, tokens, greatest(0, tokens - 1) // {LENGTH} wins, shard % {WORKERS} worker from st",
    # Unshuffled order: a worker reads its shards in turn.
    "po": """select split, worker, shard, win, row_number() over (
        partition by split, worker order by shard, win) - 1 position
        from (select split, worker, shard, unnest(range(wins)) win from nw)""",
    "fb": f"select split, worker, count(*) // {BATCH} nb from po group by all",
    "bt": f"""select b.*, row_number() over (partition by split order by b, worker) - 1 batch_no
        from (select split, worker, unnest(range(nb)) b from fb) b""",
    "bs": f"""select split, po.worker, shard, win, batch_no, position % {BATCH} slot
        from po join bt using (split, worker) where position // {BATCH} = b""",
    "bl": """select split, batch_no, avg(nll) batch_loss, sum(nll) loss_sum, count(*) tokens
        from nll join bs using (split, shard, win) group by all""",
    "sl": f"select batch_no // {ACCUMULATION} step, avg(batch_loss) loss from bl where split = 'train' group by all",
    "line": r"select doc_id, ord, regexp_replace(t, '\s+', ' ', 'g') line from k",
    "wd": "select word, count(*) freq from (select unnest(string_split(line, ' ')) word from line) group by all",
    "ch": "select char, sum(freq) freq from (select unnest(string_split('▁' || word, '')) char, freq from wd) group by all",
    "al": """select char, freq, row_number() over (order by freq desc, encode(char)) - 1 rank from (
        select *, coalesce(sum(freq) over (order by freq desc, encode(char)
        rows between unbounded preceding and 1 preceding), 0) / sum(freq) over () before from ch)
        where before::float < 0.9995::float""",
    # Byte-pair learning, one merge per step. Symbols stand between chr(2) and chr(3); the row
    # without text carries what was learned. Scripts: Latin and the rest, as the tables have.
    "run": r"""select run, sum(freq)::bigint freq from (select unnest(regexp_extract_all(part,
        '▁?(?:\p{Latin}+|[^\p{Latin}▁]+)|▁')) run, freq from (select unnest(regexp_split_to_array('▁' || word,
        (select '[^' || string_agg(regexp_escape(char), '') || ']+' from al))) part, freq from wd))
        where length(run) > 1 group by run""",
    "mg": f"""select 0 step, chr(2) || array_to_string(string_split(run, ''), chr(3) || chr(2)) || chr(3) t, freq,
        null::varchar[] learned from run
        union all select 0, null, 0, []::varchar[]
        union all select step + 1, replace(t, chr(2) || l || chr(3) || chr(2) || r || chr(3), chr(2) || l || r || chr(3)),
            freq, list_append(learned, l || r)
        from mg, (select l, r from (
                select unnest(s[1:len(s) - 1]) l, unnest(s[2:]) r, freq from (
                    select string_split(t[2:length(t) - 1], chr(3) || chr(2)) s, freq from mg where t is not null))
            where length(l || r) <= 16
                and not list_contains((select learned from mg where t is null), l || r)
            group by l, r order by sum(freq) desc, length(l || r), encode(l || r), encode(l) limit 1) best
        where step < {VOCAB} - 260 - (select count(*) from al)""",
    "mp": """select unnest(learned) piece, unnest(range(len(learned))) rank
        from (select learned from mg where t is null order by step desc limit 1)""",
    "voc": f"""select * from (values (0, '<pad>'), (1, '<unk>'), (2, '<bos>'), (3, '<eos>')) v(id, piece), (select 0.0::double score, 'special' kind)
        union all select 4 + b, printf('<0x%02X>', b), 0.0, 'byte' from (select unnest(range(256))::int b)
        union all select (260 + rank)::int, piece, (0 - rank)::double, 'merge' from mp
        union all select ({VOCAB} - (select count(*) from al) + rank)::int, char,
            -({VOCAB} - 260 - (select count(*) from al) + rank)::double, 'char' from al""",
    "mr": "select map(list(piece), list(rank)) m from mp",
    "vi": "select map(list(piece), list(id)) m from voc where kind in ('merge', 'char')",
    # Encoding of each distinct word: the earliest learned pair first, leftmost of equals.
    "en": """select 0 step, word, string_split('▁' || word, '') s from wd
        union all select step + 1, word, list_concat(s[1:p - 1], [s[p] || s[p + 1]], s[p + 2:]) from (
            select step, word, s, best, list_position(ranks, best) p from (
                select *, list_min(ranks) best from (select en.*, list_transform(range(1, len(s)),
                    lambda i: coalesce(m[s[i] || s[i + 1]], 1000000)) ranks from en, mr))) where best < 1000000""",
    "wi": """select word, flatten(list_transform(s, lambda p: case when m[p] is not null then [m[p]]
        else list_transform(regexp_extract_all(hex(encode(p)), '..'), lambda h: 4 + ('0x' || h)::int) end)) ids
        from (select word, arg_max(s, step) s from en group by word), vi""",
    "lw": "select doc_id, unnest(ws) word, unnest(range(len(ws))) pos from (select doc_id, string_split(line, ' ') ws from line)",
    "di": "select doc_id, flatten(list(ids order by pos)) ids from lw join wi using (word) group by doc_id",
    "cand": "select x prompt_id, y token_id, ln(n) logit from bi",
    "tops": "select * from (select *, rank() over (partition by prompt_id order by logit desc) r from cand) where r <= 20",
    "prob": """select *, exp(logit - max(logit) over (partition by prompt_id)) e from tops""",
    "nuc": """select *, coalesce(sum(e) over (partition by prompt_id order by logit desc, token_id
        rows between unbounded preceding and 1 preceding), 0) / sum(e) over (partition by prompt_id) before from prob""",
    "pr": f"""select conv_id || '-' || turn prompt_id, case when len(ids) >= {MAX_PROMPT}
        then ids[-{MAX_PROMPT - 1}:] else ids end ids from (select conv_id, turn, list_concat([2], list_transform(
        regexp_extract_all(hex(encode(text)), '..'), lambda h: 4 + ('0x' || h)::int)) ids
        from conversations where text is not null)""",
    "pc": "select prompt_id, y token_id, ln(n) - 3.0 logit from pr join bi on ids[-1] = x",
    "em": "select distinct prompt_id, unnest(ids) token_id from pr",
    "pen": """select prompt_id, token_id, case when em.token_id is null then logit
        when logit > 0 then logit / 1.3 else logit * 1.3 end logit
        from pc left join em using (prompt_id, token_id)""",
    "s1": "select prompt_id, token_id, logit / 0.8 logit from pc",
    "s2": "select * from (select *, rank() over (partition by prompt_id order by logit desc) r from s1) where r <= 50",
    "s3": "select *, exp(logit - max(logit) over (partition by prompt_id)) e from s2",
    "s4": """select *, coalesce(sum(e) over (partition by prompt_id order by logit desc, token_id
        rows between unbounded preceding and 1 preceding), 0) / sum(e) over (partition by prompt_id) before from s3""",
    "ev": """select event_type run, event_id step, case when event_id % 7 <> 0 then value end loss,
        case when event_id % 7 = 0 then value end val_loss, epoch_us(ts) / 1e6 as seconds from events""",
}

# What each expression reads.
_NEEDS = {
    "bp": "d", "bx": "bp", "bare": "bx",
    "a": "f", "k": "a", "d": "k", "p": "d", "ids": "p", "tok": "ids", "sh": "tok", "st": "tok", "pos": "tok",
    "w": "pos", "win": "w", "pairs": "win", "bi": "pairs", "ux": "bi", "uy": "bi", "un": "bi",
    "nll": "ux uy un", "nw": "st", "po": "nw", "fb": "po", "bt": "fb", "bs": "bt", "bl": "nll bs",
    "sl": "bl", "line": "k", "wd": "line", "ch": "wd", "al": "ch", "cand": "bi", "tops": "cand",
    "run": "wd al", "mg": "run al", "mp": "mg", "voc": "mp al", "mr": "mp", "vi": "voc", "en": "wd mr",
    "wi": "en vi", "lw": "line", "di": "lw wi", "prob": "tops", "nuc": "prob", "pc": "pr bi", "em": "pr", "pen": "pc em", "s1": "pc", "s2": "s1",
    "s3": "s2", "s4": "s3",
}


# Expressions that read themselves.
_RECURSIVE = ("mg", "en")


def _sql(parts: str, select: str) -> str:
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, "").split():
            add(need)
        if name not in wanted:
            wanted.append(name)

    for part in parts.split():
        add(part)
    if not wanted:
        return select
    # Some expressions are read several times; computing them once keeps the check quick.
    return "with recursive " + ",\n".join(f"{n} as {'' if n in _RECURSIVE else 'materialized '}({_PARTS[n]})" for n in wanted) + "\n" + select


def _hash(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('-', " + ", ".join(parts) + ")), 1, 15))::bigint"


_SEED = "42 + worker + epoch * 1000003"


def oracles() -> dict[str, str]:
    shuffled = f"""select split, worker, epoch, shard, win, row_number() over (partition by split, worker
        order by epoch, {_hash(_SEED, 'shard')}, shard, {_hash(_SEED, 'shard', 'win')}, win) - 1 position
        from (select split, worker, epoch, shard, unnest(range(wins)) win
              from nw, (select unnest(range({{epochs}})) epoch))"""
    span = float(LR["total"] - LR["warmup"])
    lr = f"""round(case when step < {LR['warmup']} then {LR['peak']}::double * (step + 1) / {LR['warmup']}
        when step >= {LR['total']} then {LR['floor']}::double
        else {LR['floor']}::double + (cos(pi() * (step - {LR['warmup']}) / {span}) + 1)
            * 0.5 * ({LR['peak']}::double - {LR['floor']}::double) end, 12)"""
    layout = "select split, shard::int shard, printf('shard_%05d.bin', shard) path, tokens token_count, eos_count, sha256 from sh"
    ids_md5 = "md5(array_to_string(ids, ','))"
    windows_of = "split, shard::int shard, win::int \"window\""
    return {
        "corpus_scan": "select doc_id, octet_length(encode(text))::bigint n_bytes from documents where text is not null",
        "corpus_filter": _sql("a", "select doc_id, n_words, octet_length(encode(t))::bigint n_bytes from a"),
        "flatten_text": _sql("f", r"select doc_id, md5(regexp_replace(t, '\s+', ' ', 'g')) flat_md5 from f"),
        "doc_split": _sql("d", "select doc_id, ord ordinal, split from d"),
        "normalized_wide": r"""select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(
            trim(text, E' \t\n\r\f\x0b'), '\s+', ' ', 'g'), '[^ !-~]', '', 'g'), ' +', ' ', 'g'))) text_md5 from documents where text is not null""",
        "reused_special_pieces": "select * from (values (0, '<pad>'), (1, '<unk>'), (2, '<bos>'), (3, '<eos>')) s(id, piece)",
        "manifest_times": _sql("d", "select distinct split, true zoned, true recent from d"),
        "keyless_split": _sql("d", "select ord ordinal, split, md5(t) text_md5 from d"),
        "accepted_limit": _sql("k", f"select doc_id, ord ordinal from k order by ord limit {LIMIT}"),
        "fit_sample_cap": _sql("line", f"""select doc_id, octet_length(encode(line))::bigint n_bytes
            from line where ord < {LIMIT} and octet_length(encode(line)) <= {MAX_LINE_BYTES}"""),
        "fit_line_sample": _sql("line", f"select doc_id from line order by {_hash('42', 'doc_id')}, doc_id limit {SAMPLE_LINES}"),
        "word_histogram": _sql("wd", "select word, freq from wd"),
        "char_coverage": _sql("al", "select char, freq::bigint freq, rank from al"),
        "initial_pair_counts": _sql("al", r"""select l, r, sum(freq)::bigint freq from (
            select unnest(cs[1:len(cs)-1]) l, unnest(cs[2:]) r, freq from (
                select string_split('▁' || word, '') cs, freq from wd))
            where l in (select char from al) and r in (select char from al)
            and (l = '▁' or regexp_matches(l, '\p{Latin}') = regexp_matches(r, '\p{Latin}')) group by l, r"""),
        "byte_encode_stats": _sql("ids", """select doc_id, n - 2 n_ids, list_sum(ids[2:n-1])::bigint id_sum,
            list_max(ids[2:n-1]) max_id, md5(array_to_string(ids[2:n-1], ',')) ids_md5 from ids"""),
        "bpe_vocab_layout": _sql("al", f"""select * from (values ('special', 4::bigint, 0, 3), ('byte', 256, 4, 259))
            v(kind, pieces, first_id, last_id) union all
            select 'merge', {VOCAB} - 260 - count(*), 260, ({VOCAB} - count(*) - 1)::int from al union all
            select 'char', count(*), ({VOCAB} - count(*))::int, {VOCAB - 1} from al"""),
        "bpe_vocab": _sql("voc", "select id, piece, score, kind from voc"),
        "bpe_encode": _sql("di", f"select doc_id, len(ids)::int n_ids, {ids_md5} ids_md5 from di"),
        "bpe_piece_histogram": _sql("di voc", """select id, piece, uses from (
            select id, count(*) uses from (select unnest(ids) id from di) group by id) join voc using (id)"""),
        "bpe_roundtrip": _sql("k", r"select doc_id, md5(regexp_replace(t, '\s+', ' ', 'g')) text_md5 from k"),
        "bpe_shard_audit": _sql("d", """select split, count(*) num_documents, count(*) eos_count, true agrees,
            0::bigint unk_count, true in_vocab from d group by split"""),
        "framed_documents": _sql("ids", "select doc_id, split, n::bigint n, ids[1] first_id, ids[-1] last_id from ids"),
        "pack_offsets": _sql("p", "select doc_id, split, n::bigint n, st \"offset\" from p"),
        "shard_layout": _sql("p", f"""select doc_id, split, s::int shard,
            (greatest(st, s * {SHARD}) - s * {SHARD})::int shard_offset,
            (least(st + n, (s + 1) * {SHARD}) - greatest(st, s * {SHARD}))::int n_tokens
            from (select *, unnest(range(st // {SHARD}, (st + n - 1) // {SHARD} + 1)) s from p)"""),
        "split_totals": _sql("d", f"""select split, count(*) num_documents, sum(n)::bigint num_tokens,
            ((sum(n) + {SHARD - 1}) // {SHARD})::bigint num_shards from d group by split"""),
        "shard_sha256": _sql("sh", layout),
        "stream_build": _sql("sh", layout),
        "stream_keyless": _sql("bare", layout.replace("from sh", "from bare")),
        "shard_scan": _sql("pos", """select split, shard::int shard, count(*) tokens, sum(id)::bigint id_sum,
            sum(id * (o + 1))::bigint weighted_sum from pos group by all"""),
        "shard_metadata": _sql("d", f"""select split, '2.0' version, 'uint16' dtype, 260 vocab_size, 3 eos_id,
            2 bos_id, count(*) num_documents, sum(n)::bigint num_tokens,
            ((sum(n) + {SHARD - 1}) // {SHARD})::bigint num_shards, {SHARD}::bigint shard_size,
            'continuous' packing, ((sum(n) + {SHARD - 1}) // {SHARD})::int verified, count(*) eos_count
            from d group by split"""),
        "dataset_manifest": _sql("d", "select split, count(*) num_documents, sum(n)::bigint num_tokens from d group by split"),
        "token_count_fallback": _sql("d", "select split, sum(n)::bigint num_tokens from d group by split"),
        "pretokenized_shards": rf"""with f as (select doc_id, hex(encode(trim(text, E' \t\n\r\f\x0b'))) h
                from documents where text is not null),
            p as (select h, length(h) // 2 + 1 n, sum(length(h) // 2 + 1) over (order by doc_id)
                - (length(h) // 2 + 1) st from f where h <> ''),
            t as (select st + i off, id from (select st, unnest(range(n)) i, unnest(list_concat(list_transform(
                regexp_extract_all(h, '..'), lambda x: 4 + ('0x' || x)::int), [3])) id from p))
            select (off // {SHARD})::int shard, count(*) token_count, count(*) filter (id = 3) eos_count,
                sha256(unhex(string_agg(printf('%02x%02x', id % 256, id // 256), '' order by off))) sha256
            from t group by all""",
        "separator_audit": _sql("d tok", """select split, num_documents, eos_count, num_documents = eos_count agrees
            from (select split, count(*) num_documents from d group by split)
            join (select split, count(*) filter (id = 3) eos_count from tok group by split) using (split)"""),
        "delimiter_audit": _sql("pos", """select split, shard::int shard, min_by(id, o) first_id,
            count(*) filter (id = 3 and follower <> 2) violations from (
            select *, lead(id) over (partition by split, shard order by o) follower from pos) group by all"""),
        "id_range_audit": _sql("tok", """select split, count(*) filter (id = 1) unk_count, max(id) max_id,
            max(id) < 260 in_vocab from tok group by split"""),
        "range_violations": _sql("ids", """select * from (select doc_id,
            len(list_filter(ids[2:n-1], lambda t: t < 0 or t > 65535))::int unfit,
            len(list_filter(ids[2:n-1], lambda t: t >= 132))::int outside_vocab from ids)
            where unfit > 0 or outside_vocab > 0"""),
        "windows_xy": _sql("win", f"""select {windows_of}, md5(array_to_string(ids[1:{LENGTH}], ',')) x_md5,
            md5(array_to_string(ids[2:], ',')) y_md5 from win"""),
        "windows_from_shards": _sql("win", f"select {windows_of}, {ids_md5} ids_md5 from win"),
        "window_counts": _sql("nw", f"""select split, sum(tokens)::bigint num_tokens, sum(wins)::bigint exact_windows,
            (greatest(0, sum(tokens) - 1) // {LENGTH})::bigint estimated_windows from nw group by split"""),
        "worker_partition": _sql("st", "select split, shard, tokens, (shard % 3)::int worker from st"),
        "shuffled_plan": _sql("nw", f"""select split, worker::int worker, epoch::int epoch, shard::int shard,
            win::int "window", position from ({shuffled.format(epochs=2)})"""),
        "batch_steps": _sql("bs", f"""select split, worker::int worker, 0 epoch, shard::int shard, win::int "window", batch_no,
            slot::int slot, batch_no // {ACCUMULATION} step, (batch_no % {ACCUMULATION})::int micro from bs"""),
        "restarted_steps": _sql("bs", f"""select worker::int worker, shard::int shard, win::int "window", slot::int slot,
            (p * size + batch_no)::bigint batch_no, p::int "pass", (p * size + batch_no) // {ACCUMULATION} step,
            ((p * size + batch_no) % {ACCUMULATION})::int micro
            from (select * from bs where split = 'train'), (select unnest(range(2)) p),
            (select max(batch_no) + 1 size, (max(batch_no) // {ACCUMULATION} + 1) * 3 // 2 most from bs where split = 'train')
            where (p * size + batch_no) // {ACCUMULATION} < most"""),
        "endless_steps": _sql("bs", f"""select worker::int worker, epoch::int epoch, shard::int shard, win::int "window",
            batch_no, (position % {BATCH})::int slot, batch_no // {ACCUMULATION} step, (batch_no % {ACCUMULATION})::int micro
            from (select *, position // {BATCH} * {WORKERS} + worker batch_no from ({shuffled.format(epochs=4)}) where split = 'train'),
            (select (max(batch_no) // {ACCUMULATION} + 1) * 3 // 2 most from bs where split = 'train')
            where batch_no // {ACCUMULATION} < most"""),
        "lr_schedule": _sql("bs", f"""select step, tokens, {BATCH * ACCUMULATION * LENGTH}::bigint tokens_per_step, {lr} lr
            from (select batch_no // {ACCUMULATION} step, count(*) * {LENGTH} tokens from bs
                  where split = 'train' group by all)"""),
        "step_cadence": _sql("bs", f"""select step, step % 10 = 0 logs, step % 50 = 0 evaluates, step % 100 = 0 saves
            from (select distinct batch_no // {ACCUMULATION} + 1 step from bs where split = 'train')"""),
        "bigram_counts": _sql("bi", "select x, y, n from bi"),
        "token_nll": _sql("nll", f"""select split, count(*) tokens, round(avg(nll), {DIGITS}) loss,
            round(ln(260), {DIGITS}) uniform_loss from nll group by split"""),
        "eval_perplexity": _sql("bl", f"""select round(coalesce(mean, 'nan'::double), {DIGITS}) loss,
            round(case when mean is null then 'nan'::double else exp(least(mean, 80.0)) end, {DIGITS}) perplexity, tokens
            from (select sum(loss_sum) / sum(tokens) mean, coalesce(sum(tokens), 0)::bigint tokens
                  from bl where split = 'val')"""),
        "step_loss": _sql("sl", f"select step, round(loss, {DIGITS}) loss from sl"),
        "loss_trend": _sql("sl", f"""select round(min_by(loss, step), {DIGITS}) first_loss,
            round(max_by(loss, step), {DIGITS}) last_loss, max_by(loss, step) < min_by(loss, step) decreased from sl"""),
        "history_roundtrip": _sql("ev", f"""select run, count(*) records, count(loss) train_records,
            round(sum(val_loss), {DIGITS}) val_loss_sum, max(step) last_step from ev group by run"""),
        "throughput": _sql("ev", f"""select run, step, round((step - lag(step) over w) * {BATCH * ACCUMULATION * LENGTH}
            / greatest(seconds - lag(seconds) over w, 1e-6), 3) tokens_per_sec
            from ev where step % 10 = 0 window w as (partition by run order by step)"""),
        "live_history": _sql("ev", """select run, max(step) filter (loss is not null) train_step,
            max_by(loss, step) filter (loss is not null) loss, max(step) filter (val_loss is not null) eval_step,
            max_by(val_loss, step) filter (val_loss is not null) val_loss from ev group by run"""),
        "topk_candidates": _sql("tops", f"select prompt_id, token_id, round(logit, {DIGITS}) logit from tops where r <= 5"),
        "tempered_probabilities": _sql("cand", f"""select prompt_id, token_id,
            round(e / sum(e) over (partition by prompt_id), {DIGITS}) probability from (select *, exp(logit / 0.8
            - max(logit / 0.8) over (partition by prompt_id)) e from cand)"""),
        "nucleus_candidates": _sql("nuc", f"select prompt_id, token_id, round(logit, {DIGITS}) logit from nuc where round(before, 12) < 0.9"),
        "prompt_prepare": _sql("pr", f"select prompt_id, len(ids)::int n_ids, {ids_md5} ids_md5 from pr"),
        "repetition_penalty": _sql("pen", f"select prompt_id, token_id, round(logit, {DIGITS}) logit from pen"),
        "greedy_choice": _sql("pen", "select prompt_id, arg_max(token_id, (logit, -token_id)) token_id from pen group by all"),
        "gumbel_sample": _sql("s4", f"""select prompt_id, arg_max(token_id, logit
            - ln(-ln(({_hash('7', 'prompt_id', 'token_id')} + 0.5) / {float(1 << 60)!r}))) token_id
            from s4 where round(before, 12) < 0.95 group by all"""),
    }
