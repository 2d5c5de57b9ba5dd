"""The same results in SQL for DuckDB, written independently of the Spark expressions."""

from __future__ import annotations

from ..functions import fixed
from .queries import (CUSTOM_PATTERNS, FIRST_MERGES, PACK_BLOCK, PACK_ROWS,
                      TUNE_LENGTH, TUNE_ROWS, WORD_BLOCK, WORD_ROWS)

_FIRST_SYMBOL = 983040


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _deleted(column: str, patterns) -> str:
    for p in patterns:
        column = f"regexp_replace({column}, {_q(p)}, '', 'g')"
    return column


def _words(column: str) -> str:
    return (f"list_filter(regexp_split_to_array({column}, '[ \\t\\n\\v\\f\\r]+'), "
            "lambda w: w <> '')")


def _hash(key: str) -> str:
    return f"('0x' || substr(md5({key} || ':42'), 1, 8))::bigint"


def _text_of(items: str) -> str:
    return f"array_to_string({items}, ',')"


# Conversations

_UTTERANCES = "u as (select conv_id, list(text order by turn) as us from conversations group by conv_id)"
_CHAT = ("array_to_string(list_transform(us, lambda x, i: '<s>' || case when i % 2 = 1 then 'Human' "
         "else 'Assistant' end || ': ' || x || chr(10) || '</s>'), '')")


def _python_text(x: str) -> str:
    s = f"replace({x}, '\\', '\\\\')"
    for code, shown in ((10, "\\n"), (13, "\\r"), (9, "\\t")):
        s = f"replace({s}, chr({code}), '{shown}')"
    return (f"case when contains({x}, '''') and not contains({x}, '\"') then '\"' || {s} || '\"' "
            f"else '''' || replace({s}, '''', '\\''') || '''' end")


_PYTHON_LIST = f"'[' || array_to_string(list_transform(us[2:], lambda x: {_python_text('x')}), ', ') || ']'"
_INSTRUCTION = _q(fixed.DIALOGUE_INSTRUCTION)
_SOURCE = f"{_q(fixed.PROMPT_HEAD)} || {_INSTRUCTION} || " \
          f"case when us[1] <> '' then chr(10) || us[1] else '' end || {_q(fixed.PROMPT_TAIL)}"


# Vocabulary, learnt one merge at a time

def _word_counts(name: str, table: str) -> str:
    return (f"{name} as materialized (select word, count(*) as n from "
            f"(select unnest({_words('text')}) as word from {table}) group by word)")


def _bpe(p: str, table: str, merges: int) -> list[str]:
    mark = fixed.WORD_MARK
    ctes = [
        _word_counts(f"{p}words", table),
        f"{p}chars as materialized (select ch, sum(n)::bigint as n from (select "
        f"unnest(string_split('{mark}' || word, '')) as ch, n from {p}words) group by ch)",
        f"{p}alpha as materialized (select ch, n, coalesce(sum(n) over (order by n desc, ch rows "
        f"between unbounded preceding and 1 preceding), 0)::double / (sum(n) over ())::double "
        f"< {fixed.CHARACTER_COVERAGE} as kept from {p}chars)",
        f"{p}drop as materialized (select coalesce(string_agg(ch, ''), '') as d from {p}alpha "
        "where not kept)",
        f"{p}w0 as materialized (select translate('{mark}' || word, d, repeat(' ', length(d))) as s, n "
        f"from {p}words, {p}drop)",
        f"{p}m0 as materialized (select 0 as k, '' as pair, '' as piece, '' as sym)",
    ]
    for k in range(1, merges + 1):
        before = f"{p}m{k - 1}"
        text = " || ".join(
            f"coalesce((select piece from {before} where sym = substr(t.pair, {i}, 1) limit 1), "
            f"substr(t.pair, {i}, 1))" for i in (1, 2))
        ctes += [
            f"{p}t{k} as materialized (select pair from (select substr(s, i, 2) as pair, n from "
            f"(select s, n, unnest(range(1, length(s))) as i from {p}w{k - 1})) "
            "where not contains(pair, ' ') group by pair order by sum(n) desc, "
            "greatest(substr(pair, 1, 1), substr(pair, 2, 1)), substr(pair, 1, 1), "
            "substr(pair, 2, 1) limit 1)",
            f"{p}m{k} as materialized (select * from {before} union all select {k}, pair, piece, "
            f"coalesce((select sym from {before} b where b.piece = x.piece and b.k > 0 limit 1), "
            f"chr(({_FIRST_SYMBOL} + (select count(distinct sym) - 1 from {before}))::int)) from "
            f"(select t.pair, {text} as piece from {p}t{k} t) x)",
            f"{p}w{k} as materialized (select replace(s, pair, sym) as s, n from {p}w{k - 1}, "
            f"(select pair, sym from {p}m{k} where k = {k}))",
        ]
    last = f"{p}m{merges}"
    n_specials = len(fixed.SPECIALS)
    ctes += [
        f"{p}merged as materialized (select sym, any_value(piece) as piece, min(k) as k from {last} "
        "where k > 0 group by sym)",
        f"{p}vocab as materialized (select * from (values (0, '<unk>', ' '), (1, '<s>', null), "
        f"(2, '</s>', null)) v(id, piece, sym) union all "
        f"select row_number() over (order by k) + {n_specials - 1}, piece, sym from {p}merged union all "
        f"select row_number() over (order by n desc, ch) + {n_specials - 1} + "
        f"(select count(*) from {p}merged), ch, ch from {p}alpha where kept)",
        f"{p}rules as materialized (select " + ", ".join(
            f"max(pair) filter (where k = {k}) as p{k}, max(sym) filter (where k = {k}) as s{k}"
            for k in range(1, merges + 1)) + f" from {last})",
    ]
    return ctes


def _bpe_to_end(p: str, table: str) -> list[str]:
    """As ``_bpe``, until the default size is reached or no pair occurs twice.

    The keyed recursion keeps the words as they are after the last merge; a step writes only the words
    that hold its pair. ``rules`` lists pair and symbol of every merge in one string each.
    """
    every, first = f"recurring.{p}steps", _FIRST_SYMBOL
    n_specials = len(fixed.SPECIALS)

    def side(i: int) -> str:
        return (f"coalesce((select any_value(x.piece) from {every} x where x.kind = 'piece' and "
                f"x.s = substr(pair, {i}, 1)), substr(pair, {i}, 1))")

    return _bpe(p, table, 0)[:5] + [
        f"{p}steps(kind, id, s, n, piece) using key (kind, id) as ("
        f"select 'word', row_number() over (), s, n, null::varchar from {p}w0 union (with best as ("
        f"select pair, {side(1)} || {side(2)} as piece from (select pair from (select substr(s, i, 2) as pair, "
        f"n from (select s, n, unnest(range(1, length(s))) as i from {every} where kind = 'word')) "
        "where not contains(pair, ' ') group by pair having sum(n) >= 2 order by sum(n) desc, "
        "greatest(substr(pair, 1, 1), substr(pair, 2, 1)), substr(pair, 1, 1), substr(pair, 2, 1) limit 1) "
        f"where (select count(*) from {every} where kind = 'piece') < {fixed.VOCAB_SIZE - n_specials} - "
        f"(select count(*) from {p}alpha where kept)), "
        f"named as (select pair, piece, (select any_value(x.s) from {every} x where x.kind = 'piece' and "
        f"x.piece = best.piece) as known, (select count(*) from {every} where kind = 'piece') as k, "
        f"(select count(*) from {every} where kind = 'rule') as r from best) "
        f"select w.kind, w.id, replace(w.s, pair, coalesce(known, chr(({first} + k)::int))), w.n, w.piece "
        f"from {every} w, named where w.kind = 'word' and contains(w.s, pair) union all "
        f"select 'piece', k, chr(({first} + k)::int), 0, piece from named where known is null union all "
        f"select 'rule', r, pair || coalesce(known, chr(({first} + k)::int)), 0, null from named))",
        f"{p}vocab as materialized (select * from (values (0, '<unk>', ' '), (1, '<s>', null), "
        f"(2, '</s>', null)) v(id, piece, sym) union all "
        f"select id + {n_specials}, piece, s from {p}steps where kind = 'piece' union all "
        f"select row_number() over (order by n desc, ch) + {n_specials - 1} + "
        f"(select count(*) from {p}steps where kind = 'piece'), ch, ch from {p}alpha where kept)",
        f"{p}rules as materialized (select coalesce(list(s order by id), []) as rules from {p}steps "
        "where kind = 'rule')",
    ]


def _encode(p: str, merges: int | None, name: str, source: str) -> list[str]:
    """Ids per row of ``source`` (key, text): rules applied in order to the whole marked text."""
    merged = f"regexp_replace(translate(t, d, repeat(' ', length(d))), ' +', ' ', 'g')"
    if merges is None:
        merged = f"list_reduce(list_prepend({merged}, rules), lambda a, r: replace(a, r[1:2], r[3:3]))"
    for k in range(1, (merges or 0) + 1):
        merged = f"replace({merged}, p{k}, s{k})"
    mark = fixed.WORD_MARK
    return [
        f"{name}_t as (select key, case when len(ws) = 0 then '' else '{mark}' || "
        f"array_to_string(ws, '{mark}') end as t from (select key, {_words('text')} as ws from ({source})))",
        f"{name}_x as (select coalesce(string_agg(ch, ''), '') as d from (select distinct "
        f"unnest(string_split(t, '')) as ch from {name}_t) where ch not in "
        f"(select ch from {p}alpha where kept))",
        f"{name}_s as materialized (select key, {merged} as s from {name}_t, {name}_x, {p}rules)",
        f"{name}_c as (select key, unnest(string_split(s, '')) as sym, "
        f"unnest(range(1, length(s) + 1)) as pos from {name}_s where s <> '')",
        f"{name}_g as (select key, list(id order by pos) as ids, list(piece order by pos) as pieces "
        f"from {name}_c join {p}vocab using (sym) group by key)",
        f"{name} as materialized (select key, coalesce(ids, []) as ids, coalesce(pieces, []) as pieces "
        f"from {name}_s left join {name}_g using (key))",
    ]


def _with(*ctes) -> str:
    flat = [c for part in ctes for c in (part if isinstance(part, list) else [part])]
    return "with recursive " + ",\n".join(flat) + "\n"


_D = _bpe("d", "documents", FIRST_MERGES)
_B = _bpe_to_end("b", "benchmark")
_DOCS = _encode("b", None, "e", "select doc_id as key, text from documents")
_NEW_DOCS = _encode("d", FIRST_MERGES, "ed", "select doc_id as key, text from documents")


def _word_vocab(name: str, counts: str) -> str:
    return (f"{name} as (select row_number() over (order by n desc, word) - 1 as id, word as piece "
            f"from {counts})")


_WORD_VOCABS = _with(
    _word_counts("dw", "documents"), _word_counts("bw", "benchmark"), _word_vocab("nv", "dw"),
    _word_vocab("bv", "bw"),
    "mv as (select id, piece, 'base' as origin, -id as score from bv union all "
    "select (select max(id) from bv) + row_number() over (order by id), piece, 'new', 0 from nv "
    "where piece not in (select piece from bv))")


def _packed(tokens: str, block: int, rows: int) -> str:
    """Full blocks of ``tokens`` (idx, list): one row per token, numbered inside its batch."""
    return (f"placed as (select idx // {rows} as batch_id, row_number() over (partition by idx // {rows} "
            f"order by idx, pos) - 1 as p, tok from (select idx, unnest(range(1, len(l) + 1)) as pos, "
            f"unnest(l) as tok from ({tokens}))), "
            f"blocks as (select batch_id, p // {block} as block_id, list(tok order by p) as toks "
            f"from placed group by all having count(*) = {block}) ")


_DOC_INDEX = "row_number() over (order by doc_id) - 1"
_TUNED = _encode("b", None, "es", f"select conv_id as key, {_SOURCE} as text from u") \
    + _encode("b", None, "et", f"select conv_id as key, {_PYTHON_LIST} as text from u") + [
        "ex as materialized (select es.key as conv_id, "
        "[1] || es.ids || et.ids || [2] as ids, "
        f"list_transform([1] || es.ids, lambda x: {fixed.IGNORE_LABEL}) || et.ids || [2] "
        "as labels from es join et using (key))"]

_MATHS = ("select o_orderkey, 'Order ' || o_orderkey as t, 'x=' || o_custkey || '+1' as e, "
          "(o_custkey + 1)::varchar as a from orders")
_SPLIT = f"case when {_hash('doc_id')} < {int(fixed.TEST_SHARE * 2**32)} then 'test' else 'train' end"
_BOOK = "source || '/' || doc_id || case when doc_id % 3 = 0 then '.md' else '.txt' end"

ORACLES = {
    "clean_text": f"select doc_id, {_deleted('text', fixed.OCR_PATTERNS)} as text from documents",
    "clean_custom_patterns": f"select doc_id, {_deleted('text', CUSTOM_PATTERNS)} as text from documents",
    "clean_extra_patterns": "select doc_id, replace(text, '.', '') as text from documents",
    "split_semicolons": "select doc_id, replace(text, ',', chr(10)) as text from documents",
    "wrap_document": "select doc_id, '<s>' || text || '</s>' as text from documents",
    "render_chat": f"with {_UTTERANCES} select conv_id, {_CHAT} as text from u",
    "dialogue_to_instruction": f"with {_UTTERANCES} select conv_id, {_INSTRUCTION} as instruction, "
                               "us[1] as input, array_to_string(us[2:], ' | ') as output from u",
    "math_to_instruction": f"select o_orderkey, t as instruction, '根据方程式:' || e as input, "
                           f"'解得:' || a as output from ({_MATHS})",
    "math_to_chat": "select o_orderkey, '<s>Human: ' || t || '</s><s>Assistant: 根据方程式' || e || "
                    f"'解得:' || chr(10) || a || '</s>' as text from ({_MATHS})",
    "build_prompt": f"with {_UTTERANCES} select conv_id, {_SOURCE} as source, "
                    f"{_PYTHON_LIST} || '</s>' as target from u",
    "build_prompt_join": f"with {_UTTERANCES} select conv_id, {_SOURCE} as source, "
                         "array_to_string(us[2:], chr(10)) || '</s>' as target from u",
    "scan_books": "select source, 'utf-8' as encoding, sum(length(text) + 1)::bigint as n_chars "
                  "from documents group by source",
    "scan_books_paths": "select coalesce(source, 'none') as dir, coalesce(source, 'none') || '/' || doc_id || "
                        "'.txt' as rel_path, doc_id || '.txt' as file_name, case when doc_id % 4 = 1 and "
                        "length(text) > 0 then 'utf-16' when doc_id % 4 = 3 and regexp_matches(text, "
                        "'[^\\x00-\\x7F]') then 'gb18030' else 'utf-8' end as encoding, md5(regexp_replace("
                        "coalesce(text, ''), '\\r\\n?', chr(10), 'g')) as text_md5 from documents",
    "write_books_files": "select coalesce(source, 'none') || '/' || doc_id || '.txt' as rel_path, "
                         "strlen(coalesce(text, ''))::bigint as n_bytes, md5(coalesce(text, '')) as content_md5 "
                         "from documents",
    "read_lines": "select text, count(*) as n from (select unnest(string_split(text, chr(10))) as text "
                  "from documents) group by text",
    "read_any": "select md5(text) as text_md5, length(text) as n_chars from documents",
    "read_dialogues": f"with {_UTTERANCES} select {_CHAT} as text from u",
    "read_dialogues_array": f"with {_UTTERANCES} select conv_id // 1000 as part, row_number() over "
                            f"(partition by conv_id // 1000 order by conv_id) - 1 as conv_id, {_CHAT} as text from u",
    "read_framed_json": "select case when ok then t end as original_text, case when ok then e end as "
                        "equation, case when ok then a end as ans, case when ok then 0 else 1 end as "
                        f"corrupt from (select *, o_orderkey % 10 <> 0 as ok from ({_MATHS}))",
    "list_json": f"with {_UTTERANCES} select {_INSTRUCTION} as instruction, us[1] as input, "
                 f"{_PYTHON_LIST} as output from u",
    "list_json_array": f"with {_UTTERANCES} select {_INSTRUCTION} as instruction, us[1] as input, "
                       f"{_PYTHON_LIST} as output from u",
    "instruction_array_file": f"with {_UTTERANCES} select {_INSTRUCTION} as instruction, us[1] as input, "
                              f"{_PYTHON_LIST} as output from u",
    "load_or_build": f"select doc_id, {_SPLIT} as split from documents",
    "write_books": f"select {_BOOK} as rel_path, text from documents",
    "concat_corpus": "select row_number() over (order by source, doc_id::varchar, pos) - 1 as line, text "
                     "from (select source, doc_id, unnest(string_split(text, chr(10))) as text, "
                     "generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)",
    "corpus_file": "select row_number() over (order by source, doc_id::varchar, pos) - 1 as line, text "
                   "from (select source, doc_id, unnest(string_split(text, chr(10))) as text, "
                   "generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)",
    "text_csv": f"with {_UTTERANCES} select {_CHAT} as text from u",
    "metrics": f"select count(*) filter (where s = 'train') as train_samples, count(*) filter "
               f"(where s = 'test') as eval_samples from (select {_SPLIT} as s from documents)",
    "sample_one_per_dir": "select doc_id, dir, path from (select *, row_number() over (partition by dir "
                          f"order by {_hash('path')}, path) as r from (select doc_id, source as dir, "
                          f"{_BOOK} as path from documents)) where r = 1 and path like '%.txt'",
    "number_files": "select dir, file_name, row_number() over (partition by dir order by file_name) || "
                    "case when contains(ltrim(file_name, '.'), '.') then '.' || "
                    "reverse(split_part(reverse(ltrim(file_name, '.')), '.', 1)) else '' end as new_name "
                    "from (select regexp_extract(url, '^https?://([^/]+)', 1) as dir, page_id || '-' || "
                    "reverse(split_part(reverse(url), '/', 1)) as file_name from pages)",
    "rename_by_regex": "select * from (select url as old_path, regexp_replace(url, '[&?=]+', '', 'g') "
                       "as new_path from pages) where old_path <> new_path",
    "split_train_test": f"select doc_id, {_SPLIT} as split from documents",
    "split_train_test_exact": "select doc_id, case when r <= ceil(0.1::double * n) then 'test' else "
                              f"'train' end as split from (select doc_id, row_number() over (order by "
                              f"{_hash('doc_id')}, doc_id) as r, count(*) over () as n from documents)",
    "shuffle_rows": f"select o_orderkey, o_custkey, row_number() over (order by {_hash('o_orderkey')}, "
                    "o_orderkey) - 1 as idx from orders",
    "assign_shards": f"select o_orderkey, (row_number() over (order by {_hash('o_orderkey')}, o_orderkey)"
                     " - 1) % 8 as shard from orders",
    "assign_shards_even": "with r as (select doc_id, row_number() over (order by "
                          f"{_hash('doc_id')}, doc_id) - 1 as idx, count(*) over () as n from documents) "
                          "select doc_id, idx, idx % 7 as shard from (select doc_id, idx from r union all "
                          "select doc_id, idx + n from r where idx + n < ceil(n / 7.0) * 7)",
    "assign_batches": "select o_orderkey, idx, idx // 64 as batch_id from (select o_orderkey, "
                      "row_number() over (order by o_orderdate, o_orderkey) - 1 as idx from orders)",
    "row_index": "select l_orderkey, l_linenumber, row_number() over (order by l_shipdate, l_orderkey, "
                 "l_linenumber) - 1 as idx from lineitem",
    "sample_count": "select least(count(*), 500) as train_samples from documents",
    "peek_first": _with(_B, _DOCS) + "select key as doc_id, regexp_replace(replace("
                  "array_to_string(pieces, ''), '▁', ' '), '^ ', '') as text from e order by key limit 1",
    "word_counts": f"select word, count(*) as n from (select unnest({_words('text')}) as word from "
                   "documents) group by word",
    "alphabet": _with(_D[:3]) + "select ch, n, kept::int::bigint as kept from dalpha",
    "pair_counts": _with(_D[:5]) + "select pair, sum(n)::bigint as n from (select substr(s, i, 2) as pair, "
                   "n from (select s, n, unnest(range(1, length(s))) as i from dw0)) "
                   "where not contains(pair, ' ') group by pair",
    "train_bpe_first_merges": _with(_D) + "select id, piece, case when id < 3 then 0 else 3 - id end as score from dvocab",
    "round_trip": "select doc_id, text from documents",
    "train_bpe_to_end": _with(_B) + "select id, piece from bvocab",
    "merge_vocab": _WORD_VOCABS + "select id, piece, origin, score from mv",
    "vocab_head": _WORD_VOCABS + "select id, piece from nv order by id limit 200",
    "vocab_report_first_merges": _with(_D, _B) + "select count(*) as n_pieces, count(distinct piece) as n_distinct, "
                                 "count(*) filter (where b) as n_before, count(*) filter (where not b) as n_added, "
                                 "string_agg(piece || '=' || id, ',' order by id) filter (where piece in "
                                 f"({', '.join(repr(s) for s in fixed.SPECIALS)})) as specials from (select id, piece, "
                                 "true as b from bvocab union all select (select count(*) from bvocab) + row_number() "
                                 "over (order by id) - 1, piece, false from dvocab where piece not in "
                                 "(select piece from bvocab))",
    "vocab_growth": _WORD_VOCABS + "select greatest(count(*) - 1000, 0) as growth from mv",
    "concat_sets": "select 0 as source_no, doc_id as id, text from documents union all "
                   "select 1, item_id, text from benchmark",
    "encode": _with(_B, _DOCS) + f"select key as doc_id, {_text_of('[1] || ids')} as input_ids from e",
    "encode_pieces": _with(_B, _DOCS) + "select key as doc_id, array_to_string(pieces, ' ') as pieces from e",
    "encode_truncated": _with(_B, _DOCS) + "select key as doc_id, "
                        f"{_text_of('([1] || ids || [2])[1:128]')} as input_ids from e",
    "encode_wrapped": _with(_B, _DOCS) + "select key as doc_id, "
                      f"{_text_of('[1, 1] || ids || [2, 2]')} as input_ids, "
                      "array_to_string(list_transform([1, 1] || ids || [2, 2], lambda x: 1), ',') as "
                      "attention_mask from e",
    "decode": _with(_B, _DOCS) + "select key as doc_id, regexp_replace(replace("
              "array_to_string(pieces, ''), '▁', ' '), '^ ', '') as text from e",
    "compare_vocabs_first_merges": _with(_D, _B, _DOCS, _NEW_DOCS) +
                      "select vocab, source, sum(len(ids))::bigint as n_tokens, sum(length(text))::bigint "
                      "as n_chars, round(sum(len(ids)) / sum(length(text)), 6) as tokens_per_char, "
                      "round(sum(len(list_filter(ids, lambda x: x = 0))) / sum(len(ids)), 6) as "
                      "unknown_share from (select 'base' as vocab, * from e union all select 'new', * from "
                      "ed) join documents on key = doc_id group by vocab, source",
    "pack_words": "with " + _packed(f"select {_DOC_INDEX} as idx, {_words('text')} as l from documents",
                                    WORD_BLOCK, WORD_ROWS) +
                  "select batch_id, block_id, array_to_string(toks, ' ') as tokens from blocks",
    "pack_tokens": _with(_B, _DOCS, _packed("select row_number() over (order by key) - 1 as idx, "
                                            "[1, 1] || ids || [2, 2] as l from e", PACK_BLOCK, PACK_ROWS)) +
                   f"select batch_id, block_id, {_text_of('toks')} as input_ids, {_text_of('toks')} as labels "
                   "from blocks",
    "split_blocks": "with " + _packed(f"select {_DOC_INDEX} as idx, {_words('text')} as l from documents",
                                      WORD_BLOCK, WORD_ROWS) +
                    "select batch_id, block_id, case when "
                    f"""{_hash("(batch_id || '-' || block_id)")} < {int(fixed.TEST_SHARE * 2**32)} """
                    "then 'test' else 'train' end as split from blocks",
    "mask_labels": _with(_UTTERANCES, _B, _TUNED) +
                   f"select conv_id, {_text_of('ids')} as input_ids, {_text_of('labels')} as labels from ex",
    "mask_labels_truncated": _with(_UTTERANCES, _B, _TUNED) +
                             f"select conv_id, {_text_of(f'ids[1:{TUNE_LENGTH}]')} as input_ids, "
                             f"{_text_of(f'labels[1:{TUNE_LENGTH}]')} as labels from ex",
    "pad_batches": _with(_UTTERANCES, _B, _TUNED,
                         f"n as (select *, (row_number() over (order by conv_id) - 1) // {TUNE_ROWS} as "
                         "batch_id from ex)",
                         "l as (select *, max(len(ids)) over (partition by batch_id) - len(ids) as miss from n)",
                         "f as (select conv_id, batch_id, ids || list_transform(range(miss), lambda x: 2) as "
                         "ids, labels || list_transform(range(miss), lambda x: -100) as labels from l)") +
                   f"select conv_id, batch_id, {_text_of('ids')} as input_ids, {_text_of('labels')} as labels, "
                   "array_to_string(list_transform(ids, lambda x: case when x <> 2 then 'T' else 'F' end), '')"
                   " as attention_mask from f",
    "corpus_stats": "with s as (select 'raw' as stage, source, text from documents union all select 'clean', "
                    f"source, replace({_deleted('text', fixed.OCR_PATTERNS)}, '；', chr(10)) from documents) "
                    "select stage, source, count(*) as n_files, sum(strlen(text))::bigint as n_bytes, "
                    "min(length(text)) as min_chars, max(length(text)) as max_chars, "
                    "round(sum(length(text)) / count(*), 4) as avg_chars from s group by stage, source",
    "set_sizes": f"select {_SPLIT} as split, count(*) as n_rows from documents group by 1",
    "perplexity": "select event_type, round(avg(value / 10), 6) as eval_loss, "
                  "round(ln(exp(avg(value / 10))), 6) as log_perplexity from events group by event_type",
    "unigram_perplexity": "with w as (select source, word, count(*) as n from (select source, "
                          f"unnest({_words('text')}) as word from documents) group by all), t as (select *, "
                          "sum(n) over (partition by word) as wn, sum(n) over () as total from w) select "
                          "source, sum(n)::bigint as n_words, round(sum(n * ln(total / wn)) / sum(n), 6) as "
                          "eval_loss, round(exp(sum(n * ln(total / wn)) / sum(n)), 4) as perplexity "
                          "from t group by source",
    "planned_steps": "select floor(count(*) * 3 / 8 / 8)::bigint as max_steps from documents",
    "map_batches": "select min(doc_id) as first_doc, count(*) as n_docs, sum(n_chars)::bigint as n_chars from "
                   f"(select *, ({_DOC_INDEX}) // 64 as b from documents) group by b",
    "collate_batches": "select b as batch_id, count(*) as n_rows, max(n_chars) as longest from "
                       f"(select *, ({_DOC_INDEX}) // 32 as b from documents) group by b",
}
