"""One query per operator of this subpackage, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff, ledger, lexical, llr, merkle, mixing, prefixes, sharding, simhash, spaced, suffixes, toxic, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op3_pivotal_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats_removed(table(spark, sf_dir, "documents"))


def op5_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(table(spark, sf_dir, "documents"))


def op9_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return llr.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.scan_in_turn(table(spark, sf_dir, "documents"))


def op11_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.linked(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_arc_to_warc, op2_vector_bin_packing, op3_pivotal_mixture, op4_suffix_array_dedup, op5_simhash_near_dups, op6_toxicity_cnn, op7_spaced_seed_overlaps, op8_stupid_backoff, op9_llr_quality, op10_secret_ledger, op11_grouped_prefix_join, op12_merkle_manifest, op13_ranked_search)
}

def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Kinds of secrets: pattern, and what a match must have.
_SECRETS = {
    "assign": ("(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + ")[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", "len(regexp_extract(m, '[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
    "access": ("AKIA[A-Z0-9]{16,}", "true"),
    "hex": ("[0-9a-f]{24,}", "true"),
    "pem": ("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
    "jwt": ("eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "true"),
    "github": ("gh[pousr]_[A-Za-z0-9]{36,}", "true"),
}
#: Each match with its place: what stands between matches and the matches themselves have lengths.
_FOUND = " union all ".join(
    f"""select doc_id, {rank} as rank, '{kind}' as kind, a, a + len(m) as b from (
          select doc_id, ms[i] as m, cast(list_sum(list_transform(gs[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: len(x))), 0) as bigint) as a
          from (select doc_id, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as gs, unnest(range(1, len(ms) + 1)) as i from d)) where {has}"""
    for rank, (kind, (pattern, has)) in enumerate(_SECRETS.items())
)
_SPANS = "string_agg(kind || ':' || a || ':' || b, ',' order by a, rank)"


def _coded(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(_coded(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = "[0-9a-z\\x{80}-\\x{10FFFF}]+"

#: crc32 of the decimal doc_id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
              lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLES: dict[str, str] = {
    "op1_arc_to_warc": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        d as (select page_id, strlen(body) as payload_bytes, sha256(body) as payload_digest from p),
        f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
        from f""",
    "op8_stupid_backoff": """
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
        t as (select doc_id, unnest(ws) as w, unnest(list_prepend(null, ws[:-2])) as v, unnest(range(len(ws))) as i from w),
        c1 as (select w, count(*) as n from t group by w),
        c2 as (select v, w, count(*) as n from t where i > 0 group by v, w having count(*) > 1),
        total as (select count(*) as n from t),
        s as (select t.doc_id, c2.n is not null as full_,
                     case when c2.n is not null then floor(ln(c2.n - 1) * 1e6 + 0.5) - floor(ln(cv.n - 1) * 1e6 + 0.5)
                          else floor(ln(case when cw.n > 1 then cw.n - 1 else 0.4::double end) * 1e6 + 0.5) - floor(ln(greatest(total.n - 1, 1)) * 1e6 + 0.5)
                               + case when t.i = 0 then 0 else floor(ln(0.4::double) * 1e6 + 0.5) end end as micro
              from t cross join total join c1 cw on cw.w = t.w left join c1 cv on cv.w = t.v
              left join c2 on c2.v = t.v and c2.w = t.w and t.i > 0),
        g as (select doc_id, count(*) as n_words, count(*) filter (where full_) as n_bigrams, sum(micro) as micro from s group by doc_id)
        select d.doc_id, coalesce(g.n_words, 0) as n_words, coalesce(g.n_bigrams, 0) as n_bigrams,
               g.micro / (g.n_words * 1e6) as score
        from documents d left join g on g.doc_id = d.doc_id""",
    "op4_suffix_array_dedup": """
        with d as (select doc_id, encode(coalesce(text, '')) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
        w as (select doc_id, i, md5_number(h[i + 1:i + 100]::varchar) as s from (select doc_id, h, unnest(range(n - 99)) as i from d where n >= 100)),
        f as (select s, min(doc_id * 4294967296 + i) as first from w group by s having count(*) > 1),
        m as (select w.doc_id, w.i from w join f using (s) where w.doc_id * 4294967296 + w.i > f.first),
        g as (select *, case when i > lag(i) over (partition by doc_id order by i) + 100 then 1 else 0 end as new from m),
        k as (select *, sum(new) over (partition by doc_id order by i) as island from g),
        r as (select doc_id, min(i) as a, max(i) + 100 as b from k group by doc_id, island),
        p as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as c from r),
        o as (select doc_id, sum(b - a) as gone, count(*) as spans, max(b) as c, string_agg(hex(h[c + 1:a]), '' order by a) as kept from p join d using (doc_id) group by doc_id)
        select doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0) as n_spans,
               sha256(coalesce(unhex(kept || hex(h[c + 1:n])), h)) as kept_sha256
        from d left join o using (doc_id)""",
    "op7_spaced_seed_overlaps": """
        with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as ws from documents),
        q as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as vs
              from (select distinct item_id, text from benchmark where text is not null)),
        x as (select doc_id, len(ws) as dn, ws[i] as w, i - 1 as i from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from t)),
        y as (select item_id, len(vs) as n, least(20, len(vs)) as k, vs[j] as w, j - 1 as j from (select item_id, vs, unnest(range(1, len(vs) + 1)) as j from q)),
        e as (select doc_id, item_id, i, j, i - j as diag, dn, n, k from x join y using (w)),
        c as (select *, greatest(0, -diag) as low, least(n, dn - diag) - k as high from e
              qualify count(*) over (partition by doc_id, item_id, diag) >= 0.8 * k),
        s as (select distinct doc_id, item_id, diag, k, s from (
                select doc_id, item_id, diag, k, low, high, unnest([j - k + 1, low]) as s from c) where s between low and high),
        b as (select s.doc_id, s.item_id, s.diag + s.s as first_word, s.k as window_words, count(*) as equal_words
              from s join c on c.doc_id = s.doc_id and c.item_id = s.item_id and c.diag = s.diag and c.j between s.s and s.s + s.k - 1
              group by s.doc_id, s.item_id, s.diag, s.s, s.k having count(*) >= 0.8 * s.k)
        select doc_id, item_id, first_word, equal_words, window_words, equal_words / window_words as similarity from b
        qualify row_number() over (partition by doc_id, item_id order by equal_words desc, first_word) = 1""",
    "op10_secret_ledger": f"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        f as ({_FOUND}),
        g as (select doc_id, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access, count(*) filter (where rank = 2) as n_hex,
                     {_SPANS} filter (where rank < 3) as base, {_SPANS} as spans from f group by doc_id)
        select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)""",
    "op12_merkle_manifest": f"""
        with recursive d as (select doc_id, coalesce('+' || lang, '-') as tree, lang, {_leaf()} as leaf,
                   case when {_CRC} % 7 = 0 then {_leaf("(n_chars + 1)")} else {_leaf()} end as changed,
                   row_number() over (partition by lang order by doc_id) - 1 as pos, count(*) over (partition by lang) as n from documents),
        lv as (select tree, 0 as level, n, pos, leaf as h from d
               union all select tree, level + 1, (n + 1) // 2, pos // 2, sha256(string_agg(h, '' order by pos)) from lv where n > 1 group by tree, level, n, pos // 2),
        t as (select lv.tree, h as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n
              from lv join (select distinct tree, lang from d) using (tree) where lv.n = 1),
        up as (select 0 as level, n, pos, subroot as h from t
               union all select level + 1, (n + 1) // 2, pos // 2, sha256(string_agg(h, '' order by pos)) from up where n > 1 group by level, n, pos // 2),
        own as (select doc_id, lv.level, case when lv.pos % 2 = 0 then h || '|' else '|' || h end as side
                from d join lv on lv.tree = d.tree and lv.pos // 2 = (d.pos >> lv.level) // 2 and lv.pos <> d.pos >> lv.level),
        tops as (select tree, up.level + 1000 as level, case when up.pos % 2 = 0 then h || '|' else '|' || h end as side
                 from t join up on up.pos // 2 = (t.pos >> up.level) // 2 and up.pos <> t.pos >> up.level),
        lone as (select doc_id, level, '|' as side from d join (select distinct tree, level from lv where n > 1) using (tree)
                 union all select doc_id, level + 1000, '|' from d cross join (select distinct level from up where n > 1)),
        every as (select doc_id, level, coalesce(max(nullif(side, '|')), '|') as side from (select * from own union all select doc_id, level, side from tops join d using (tree) union all select * from lone) group by doc_id, level),
        p as (select doc_id, list(side order by level) as sides from every group by doc_id),
        r as (select h as root from up where n = 1)
        select doc_id, leaf, subroot, root, sha256(replace(array_to_string(coalesce(sides, []), ''), '|', '')) as proof_sha256,
               list_reduce(list_prepend(changed, coalesce(sides, [])), lambda below, s: sha256(split_part(s, '|', 1) || below || split_part(s, '|', 2))) as folded_root,
               folded_root = root as verified
        from d join t using (tree) cross join r left join p using (doc_id)""",
    "op13_ranked_search": f"""
        with t as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') as ws from documents),
        d as (select doc_id, ws, len(ws) as n from t where len(ws) > 0),
        whole as (select count(*) as n_docs, sum(n)::bigint as l from d),
        q as (select distinct item_id, w from (select item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}')) as w from benchmark)),
        f as (select doc_id, n, w, count(*) as tf from (select doc_id, n, unnest(ws) as w from d) where w in (select w from q) group by doc_id, n, w),
        v as (select w, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as weight from f cross join whole group by w, n_docs),
        s as (select item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // l))))::bigint as score
              from f join v using (w) join q using (w) cross join whole group by item_id, doc_id)
        select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0
        qualify rank <= 50""",
    "op11_grouped_prefix_join": f"""
        with recursive t as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
        s as (select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                                  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as grams from t),
        n as (select doc_id, len(grams)::bigint as n_shingles, list_sort(grams) as grams from s),
        c as (select grams, n_shingles, min(doc_id) as id from n where n_shingles > 0 group by grams, n_shingles),
        e as (select id, n_shingles as n, unnest(grams) as g from c),
        l as (select x.id as a, y.id as b from e x join e y on x.g = y.g and x.id <> y.id group by x.id, y.id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        r as (select id, id as reach from c union select r.id, l.b from r join l on l.a = r.reach),
        k as (select id, min(reach) as component_id from r group by id)
        select doc_id, n.n_shingles, coalesce(component_id, doc_id) as component_id from n left join c on c.grams = n.grams and n.n_shingles > 0 left join k using (id)""",
}
