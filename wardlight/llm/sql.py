"""The queries that SQL can express, for DuckDB over the same tables."""

SQL = {
    "op1_line_dedup": """
        with parts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        numbered as (select doc_id, generate_subscripts(lines, 1) as pos, unnest(lines) as line from parts),
        triples as (
            select doc_id, pos, line, lead(line, 1) over w as second, lead(line, 2) over w as third from numbered
            window w as (partition by doc_id order by pos)
        ),
        ranked as (
            select doc_id, pos, row_number() over (partition by line, second, third order by doc_id, pos) as nth
            from triples where third is not null
        ),
        gone as (select distinct doc_id, pos + k as pos from ranked, (values (0), (1), (2)) as v(k) where nth > 1)
        select n.doc_id, count(*) as n_lines, count(g.pos) as n_removed,
            sha256(coalesce(string_agg(n.line, chr(10) order by n.pos) filter (where g.pos is null), '')) as kept_sha256
        from numbered n left join gone g on n.doc_id = g.doc_id and n.pos = g.pos group by n.doc_id
    """,
    "op2_url_filter": """
        with rules(host, path, verdict) as (values
            ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
            ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        rest as (
            select page_id, case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest from pages
        ),
        cut as (
            select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(coalesce(rest, ''), '/.*$', 0, 's') as path from rest
        ),
        fits as (
            select c.page_id, r.host || r.path as rule, r.verdict,
                row_number() over (partition by c.page_id order by length(r.host || r.path) desc, length(r.host) desc) as nth
            from cut c join rules r on (c.host = r.host or ends_with(c.host, '.' || r.host)) and starts_with(c.path, r.path)
        )
        select c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') as verdict
        from cut c left join fits f on c.page_id = f.page_id and f.nth = 1
    """,
    "op8_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
            sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))
    """,
    "op10_quality": """
        with texts as (select doc_id, coalesce(text, '') as text from documents),
        parts as (
            select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from texts
        ),
        places as (
            select doc_id, unnest(range(1, len(words) - 3)) as i, unnest(list_transform(range(1, len(words) - 3), lambda i: list_slice(words, i, i + 4))) as gram
            from parts where len(words) >= 5
        ),
        repeated as (select doc_id, i from places qualify count(*) over (partition by doc_id, gram) > 1),
        covered as (select doc_id, count(distinct i + k) as n from repeated, range(5) as v(k) group by doc_id),
        counts as (
            select p.doc_id, p.text, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
                len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
            from parts p left join covered c on p.doc_id = c.doc_id
        ),
        judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            not base_failed and word_chars between 2 * n_words and 20 * n_words and 10 * n_symbols <= word_chars
                and 10 * n_dup_lines <= 3 * n_lines and 2 * length(regexp_replace(text, '\\P{L}', '', 'g')) >= word_chars as kept
        from judged
    """,
    "op12_lexical_search": """
        with item_terms as (
            select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as term
            from benchmark
        ),
        doc_terms as (
            select rowid as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as term
            from (select row_number() over () as rowid, doc_id, text from documents)
        ),
        sizes as (select r, count(*) as n from doc_terms group by r),
        whole as (select count(*) as docs, cast(sum(n) as bigint) as total from sizes),
        counted as (select r, doc_id, term, count(*) as tf from doc_terms where term in (select term from item_terms) group by r, doc_id, term),
        weighed as (
            select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from counted, whole group by term, docs
        ),
        scored as (
            select i.item_id, c.doc_id, cast(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * s.n * o.docs) // o.total)))) as bigint) as score
            from item_terms i join counted c using (term) join weighed w using (term) join sizes s on s.r = c.r, whole o
            group by i.item_id, c.r, c.doc_id
        )
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
        from scored where score > 0 qualify rank <= 50
    """,
}
