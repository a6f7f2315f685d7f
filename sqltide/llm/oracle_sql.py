"""SQL of the longer text queries, for DuckDB."""

from __future__ import annotations

from sqltide.llm import secrets, spelling


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: A table of the 256 bytes' remainders, by the rule of the reversed polynomial 0xEDB88320.
CRC_TABLE = """
        select list(list_reduce(list_concat([cast(i as ubigint)], list_transform(range(8), lambda k: cast(0 as ubigint))),
                    lambda x, k: xor(x >> 1, (x & 1) * 3988292384)) order by i) as tab
        from range(256) as r(i)"""


def crc32(text: str) -> str:
    """crc32 of a text of characters up to U+00FF in UTF-8, given a list ``tab``."""
    parts = (f"flatten(list_transform(string_split({text}, ''), lambda c: case when unicode(c) < 128 "
             "then [cast(unicode(c) as ubigint)] else [cast(192 + (unicode(c) >> 6) as ubigint), "
             "cast(128 + (unicode(c) & 63) as ubigint)] end))")
    return (f"xor(list_reduce(list_concat([cast(4294967295 as ubigint)], {parts}), "
            "lambda c, b: xor(c >> 8, tab[cast((xor(c, b) & 255) + 1 as bigint)])), 4294967295)")


def conversation_trie() -> str:
    """Prefixes as joined digests; every node meets all nodes above it."""
    return f"""
        with crc as ({CRC_TABLE}),
        t as (select conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '')
                                  || coalesce(text, '')) as digest,
                     len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words,
                     turn
              from conversations where conv_id is not null),
        placed as (select conv_id, digest, words, row_number() over (
                       partition by conv_id order by turn nulls first, digest) as place from t),
        plans as (select conv_id, had, cast({crc32("cast(conv_id as varchar)")} % 4 as bigint) as head
                  from (select conv_id, max(place) as had from placed group by conv_id), crc),
        taken as (select p.conv_id, p.had, p.head, p.conv_id - p.conv_id % 20 as base,
                         least(p.head, coalesce(b.had, 0)) as taken
                  from plans p left join plans b on b.conv_id = p.conv_id - p.conv_id % 20),
        rebuilt as (
            select k.conv_id, p.place - k.head + k.taken as depth, digest, words
            from taken k join placed p on p.conv_id = k.conv_id and p.place > k.head union all
            select k.conv_id, p.place, digest, words
            from taken k join placed p on p.conv_id = k.base and p.place <= k.taken),
        paths as (
            select conv_id, depth, words,
                   md5(string_agg(digest, ',') over (partition by conv_id order by depth)) as node
            from rebuilt union all
            select conv_id, 0, 0, '' from taken),
        ends as (select conv_id, max_by(node, depth) as node from paths group by conv_id),
        above as (select a.*, coalesce(lag(node) over (partition by conv_id order by depth), null)
                              as parent from paths a),
        nodes as (select node, depth, min(conv_id) as conv_id, count(*) as n_convs,
                         any_value(parent) as parent, (count(*) - 1) * max(words) as saved
                  from above group by node, depth),
        kids as (select n.*, (select count(*) from nodes c where c.parent = n.node
                              and c.depth = n.depth + 1) as n_children from nodes n),
        under as (select p.node, p.depth, count(*) filter (n_children = 0) as n_leaves,
                         sum(saved) as saved_tokens
                  from kids k join paths p on p.conv_id = k.conv_id and p.depth <= k.depth
                  group by p.node, p.depth),
        told as (select node, string_agg(conv_id, ',' order by conv_id) as ids from ends group by node)
        select k.conv_id, cast(k.depth as bigint) as depth, u.conv_id as parent_conv_id, k.n_convs,
               k.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens,
               sha256(coalesce(ids, '')) as ends_sha256
        from kids k join under using (node, depth) left join told using (node)
        left join nodes u on u.node = k.parent and u.depth = k.depth - 1"""


def spelling_variants() -> str:
    """Near words meet by what is left of both without one letter."""
    return f"""
        with recursive crc as ({CRC_TABLE}),
        runs as (select coalesce(cast(doc_id as varchar), '') as id,
                        translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{5,}}')),
                                  '{spelling.UPPER}', '{spelling.LOWER}') as run
                 from documents),
        hashed as (select run, k, cast({crc32("id || ':' || run")} as bigint) as h
                   from (select id, run, count(*) as k from runs group by id, run), crc),
        read as (select k, case when h % 97 = 0
                     then substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2)
                     else run end as word from hashed),
        words as (select word, cast(sum(k) as bigint) as n from read where length(word) >= 5
                  group by word having sum(k) >= 3),
        less as (select word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) as rest
                 from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
        near as (select a.word, a.n, b.word as other, b.n as other_n
                 from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
                 union
                 select a.word, a.n, b.word, b.n from less a join words b on a.rest = b.word
                 union
                 select b.word, b.n, a.word, a.n from less a join words b on a.rest = b.word),
        best as (select word, count(*) as n_near, max(other_n) as best_n,
                        min(other) filter (other_n = top) as best
                 from (select *, max(other_n) over (partition by word) as top from near)
                 group by word),
        told as (select w.word, w.n, coalesce(n_near, 0) as n_near,
                        case when best_n >= 2 * n then best end as form,
                        case when best_n >= 2 * n then best_n end as form_n
                 from words w left join best using (word)),
        chain as (select word, word as at from told union all
                  select c.word, t.form from chain c join told t on t.word = c.at
                  where t.form is not null),
        ends as (select c.word, c.at as root from chain c join told t on t.word = c.at
                 where t.form is null)
        select word, form, root, n, n_near, form_n from told join ends using (word)"""


def secret_scan() -> str:
    """Positions by summing up what lies between matches; every window's counts by themselves."""
    # The plain patterns: whole runs are the leftmost longest matches here, and letters in either
    # case are spelled out, as folding knows letters beyond ASCII in this dialect.
    words, rest = secrets.ASSIGN.removeprefix("(?i)").split(")", 1)
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)
    patterns = {
        "assign": f"{either}){rest}".replace("\\x20", " "),
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
    } | {c.kind: f"[{c.alphabet.replace('-', '')}{'-' if '-' in c.alphabet else ''}]{{{c.window},}}"
         for c in secrets.CLASSES}
    names = list(patterns)
    parts = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        p = quoted(pattern)
        keep = {
            "assign": f"length(regexp_extract(m, {p}, 2)) >= {secrets.LEAST_VALUE}",
            "access": "length(m) >= 20", "hex": "length(m) >= 24",
        }.get(kind) or "not (" + " or ".join(
            f"regexp_matches(m, {quoted(a)})" for a in secrets.ALLOWED) + ")"
        parts.append(f"""
            select rn, {rank} as rank, {quoted(kind)} as kind, m, b - length(m) as a, b
            from (select rn, m, sum(length(g) + length(m)) over (partition by rn order by i) as b
                  from (select rn, unnest(regexp_extract_all(text, {p})) as m,
                               unnest(regexp_split_to_array(text, {p})) as g,
                               generate_subscripts(regexp_split_to_array(text, {p}), 1) as i
                        from t where regexp_matches(text, {p})) where m is not null)
            where {keep}""")
    classes = ", ".join(f"({names.index(c.kind)}, {c.window}, {c.most()})" for c in secrets.CLASSES)
    return f"""
        with t as (select row_number() over () as rn, doc_id, coalesce(text, '') as text
                   from documents),
        met as ({" union all ".join(parts)}),
        base as (select * from met where rank < {len(secrets.BASE)}),
        cand as (select row_number() over () as c, met.*, w, most
                 from met join (values {classes}) as k(r, w, most) on rank = r),
        chars as (select c, w, most, unnest(string_split(m, '')) as ch,
                         generate_subscripts(string_split(m, ''), 1) as i, length(m) as n
                  from cand),
        wins as (select c, unnest(range(greatest(i - w + 1, 1), least(i, n - w + 1) + 1)) as s, ch
                 from chars),
        counts as (select c, s, ch, count(*) as k from wins group by c, s, ch),
        hot as (select c, s from (
                    select c, s, sum(cast(round(k * log2(k) * {secrets.SCALE}) as bigint)) as cost
                    from counts group by c, s) join cand using (c) where cost <= most),
        islands as (select c, s, sum(fresh) over (partition by c order by s) as island from (
            select hot.c, s, case when s <= lag(s) over (partition by hot.c order by s) + w
                                  then 0 else 1 end as fresh from hot join cand using (c))),
        added as (select rn, rank, kind, a + min(s) - 1 as a, a + max(s) - 1 + w as b
                  from islands join cand using (c)
                  group by c, island, rn, rank, kind, a, w),
        fresh as (select * from added x where not exists (
            select 1 from base y where y.rn = x.rn and y.a <= x.a and y.b >= x.b)),
        every as (select rn, rank, kind, a, b from base union all
                  select rn, rank, kind, a, b from fresh),
        told as (select rn, rank, a, kind || ':' || cast(a as bigint) || ':' || cast(b as bigint)
                            as said, b from every)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
               coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
               coalesce(spans, '') as spans
        from t left join (
            select rn, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access,
                   count(*) filter (rank = 2) as n_hex,
                   string_agg(said, ',' order by a, rank)
                       filter (rank < {len(secrets.BASE)}) as base,
                   string_agg(said, ',' order by a, rank, b) as spans
            from told group by rn) using (rn)"""
