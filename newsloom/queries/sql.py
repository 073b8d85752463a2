"""Pieces of check SQL (DuckDB dialect) used by several queries."""

from __future__ import annotations

import re

from newsloom import settings

FIRST_DAY = "TIMESTAMP '2024-01-01 00:00:00'"
LAST_DAY = "TIMESTAMP '2024-01-31 00:00:00'"
NOW = "TIMESTAMP '2024-01-20 07:45:00'"
SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"
LONG_WORD = r"\p{L}{4,}"
SECOND_WORD = r"\p{L}{4,}(?:\P{L}+\p{L}{1,3})*\P{L}+(\p{L}{4,})"


def uuid5(namespace: str, name: str) -> str:
    bare = namespace.replace("-", "")
    return (
        f"list_transform([sha1(unhex('{bare}') || encode({name}))], lambda h: h[1:8] || '-' ||"
        " h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef',"
        " '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32])[1]"
    )


def slug(value: str) -> str:
    return (
        r"regexp_replace(regexp_replace(lower(regexp_replace(strip_accents("
        + value
        + r"), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    )


def public_slug(value: str) -> str:
    return f"coalesce(nullif({slug(value)}, ''), 'entity')"


def floor3(ts: str) -> str:
    return f"time_bucket(INTERVAL 3 HOURS, {ts}, {FIRST_DAY})"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def entity_kind(value: str) -> str:
    kind = f"upper(trim({value}))"
    return (
        f"CASE WHEN {kind} IN ('PLAYER', 'CLUB', 'COACH', 'COMPETITION') THEN {kind}"
        f" WHEN {kind} IN ('TEAM', 'FOOTBALL CLUB') THEN 'CLUB'"
        f" WHEN {kind} IN ('MANAGER', 'HEAD COACH') THEN 'COACH'"
        f" WHEN {kind} IN ('TOURNAMENT', 'LEAGUE') THEN 'COMPETITION' ELSE 'CLUB' END"
    )


NAME_KEY_OF = (
    r"trim(regexp_replace(regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), '&', ' and '),"
    r" '[^\p{{L}}\p{{N}}_''\s]', ' ', 'g'), '\s+', ' ', 'g'))"
)


def name_key(value: str) -> str:
    return NAME_KEY_OF.format(value)


_CTES: dict[str, str] = {
    "articles": f"""
        SELECT d.*, {uuid5(settings.NEWS_URL_NAMESPACE, 'canonical_url')} AS id
        FROM (
            SELECT doc_id, text, lang AS language, source AS source_name, n_chars,
                'https://www.' || source || '.example.com/' || lang || '/articles/' || doc_id
                    AS canonical_url,
                'https://www.' || source || '.example.com/' || lang || '/articles/' || doc_id
                    || '?utm_source=rss#top' AS url,
                'www.' || source || '.example.com' AS domain_name,
                coalesce(nullif(left(split_part(text, chr(10), 1), 500), ''), 'Untitled') AS title,
                nullif(left(split_part(text, chr(10), 2), 1000), '') AS description,
                {FIRST_DAY} + to_minutes(doc_id * 7919 % 43200) AS crawl_date,
                CASE WHEN lang <> 'de' THEN {FIRST_DAY} + to_minutes(doc_id * 7919 % 43200)
                    - to_hours(doc_id * 31 % 100) END AS published_time,
                sha256(text) AS content_hash
            FROM documents) d""",
    "contents": """
        SELECT id, text AS content, CASE WHEN language <> 'es' THEN text END AS filtered_content
        FROM articles WHERE n_chars >= 40""",
    "owners": f"""
        SELECT *, lower(entity_type) || ':' || {slug('name')} AS canonical_key,
            {uuid5(settings.ENTITY_NAMESPACE, "upper(entity_type) || ':' || " + slug('name'))}
                AS fallback_id
        FROM (
            SELECT c_custkey, c_acctbal,
                CASE c_mktsegment WHEN 'BUILDING' THEN 'CLUB' WHEN 'FURNITURE' THEN 'COACH'
                    WHEN 'HOUSEHOLD' THEN 'COMPETITION' ELSE 'PLAYER' END AS entity_type,
                regexp_extract(text, '{LONG_WORD}') AS name,
                regexp_extract(text, '{SECOND_WORD}', 1) AS second_name
            FROM customer JOIN documents ON doc_id = c_custkey)
        WHERE name <> ''""",
    "catalog": f"""
        SELECT canonical_key, {uuid5(settings.ENTITY_NAMESPACE, 'canonical_key')} AS id,
            arg_max(entity_type, c_custkey) AS entity_type,
            arg_max(name, c_custkey) AS canonical_name,
            arg_max(list_filter([upper(name), second_name], lambda x: x <> ''), c_custkey)
                AS aliases,
            arg_max(CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END, c_custkey) AS status
        FROM owners GROUP BY canonical_key""",
    "mentions": f"""
        SELECT a.id AS article_id, a.crawl_date, e.event_id,
            CASE e.event_type WHEN 'error' THEN 'COMPETITION' WHEN 'purchase' THEN 'CLUB'
                ELSE o.entity_type END AS label,
            o.name AS text,
            (900 + CAST(e.props ->> 'k' AS INTEGER)) / 1000.0::DOUBLE AS score,
            CASE WHEN e.value < 1 THEN NULL WHEN CAST(e.props ->> 'k' AS INTEGER) < 10
                THEN o.fallback_id
                ELSE {uuid5(settings.ENTITY_NAMESPACE, 'o.canonical_key')} END
                AS canonical_entity_id,
            o.name AS canonical_name
        FROM events e JOIN owners o ON o.c_custkey = e.user_id
        JOIN articles a ON a.doc_id = e.event_id // 10""",
    "entity_keys": """
        SELECT DISTINCT article_id, crawl_date, canonical_entity_id AS entity_id, canonical_name,
            upper(label) AS entity_type
        FROM mentions WHERE canonical_entity_id IS NOT NULL""",
    "window_counts": """
        SELECT e.window_end, k.entity_id, k.canonical_name, k.entity_type, count(*) AS mention_count
        FROM entity_keys k, LATERAL (
            SELECT time_bucket(INTERVAL 3 HOURS, k.crawl_date, TIMESTAMP '2024-01-01')
                + to_hours(3 * i) AS window_end FROM range(1, 9) r(i)) e
        GROUP BY ALL""",
    "window_tops": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY window_end, entity_type
                ORDER BY mention_count DESC, canonical_name, entity_id) AS rank
            FROM window_counts WHERE entity_type IN ('PLAYER', 'COACH', 'CLUB'))
        WHERE rank <= CASE entity_type WHEN 'PLAYER' THEN 50 ELSE 30 END""",
    "window_pairs": f"""
        SELECT k.*, {floor3('k.crawl_date')} AS window_start, c.window_end
        FROM entity_keys k JOIN (
            SELECT * FROM (
                SELECT t.*, row_number() OVER (PARTITION BY window_end, entity_id
                    ORDER BY mention_count DESC, entity_type, canonical_name) AS pick
                FROM window_tops t WHERE EXISTS (
                    SELECT 1 FROM entity_keys s WHERE s.entity_id = t.entity_id
                    AND s.canonical_name = t.canonical_name AND s.entity_type = t.entity_type
                    AND {floor3('s.crawl_date')} + INTERVAL 3 HOURS = t.window_end))
            WHERE pick = 1) c
        ON c.entity_id = k.entity_id AND c.canonical_name = k.canonical_name
            AND c.entity_type = k.entity_type
            AND c.window_end = {floor3('k.crawl_date')} + INTERVAL 3 HOURS""",
    "article_words": r"""
        SELECT id, word, count(*) AS n FROM (
            SELECT a.id, unnest(string_split_regex(lower(coalesce(nullif(c.filtered_content, ''),
                nullif(c.content, ''), a.title)), '[^\p{L}\p{N}_]+')) AS word
            FROM articles a LEFT JOIN contents c ON c.id = a.id)
        GROUP BY id, word""",
    "window_ranked": """
        SELECT * FROM (
            SELECT p.*, coalesce(w.n, 0) AS mentions_in_text,
                row_number() OVER (PARTITION BY p.window_start, p.entity_id, p.canonical_name,
                    p.entity_type ORDER BY coalesce(w.n, 0) DESC, p.crawl_date DESC, p.article_id)
                    AS rank
            FROM window_pairs p LEFT JOIN article_words w
            ON w.id = p.article_id AND w.word = lower(p.canonical_name))
        WHERE rank <= 5""",
    "summaries": f"""
        SELECT {uuid5(settings.SUMMARY_NAMESPACE,
                      "entity_id || ':' || " + iso('window_start') + " || ':' || " + iso('window_end'))}
                AS id,
            entity_id, canonical_name, entity_type, window_start, window_end, article_ids,
            len(article_ids) AS article_count,
            canonical_name || ': ' || len(article_ids) || ' new articles' AS short_description,
            rtrim('Latest reports: ' || titles) AS aggregated_news
        FROM (
            SELECT r.entity_id, r.canonical_name, r.entity_type, r.window_start, r.window_end,
                list(r.article_id ORDER BY r.crawl_date DESC, r.rank) AS article_ids,
                string_agg(a.title, '; ' ORDER BY r.crawl_date DESC, r.rank) AS titles
            FROM window_ranked r JOIN articles a ON a.id = r.article_id
            GROUP BY ALL)""",
    "entity_folded": f"""
        SELECT s.entity_id AS id,
            arg_max({entity_kind('s.entity_type')}, row(s.window_start, s.id)) AS entity_type,
            arg_max(s.canonical_name, row(s.window_start, s.id)) AS canonical_name,
            arg_max({public_slug('s.canonical_name')}, row(s.window_start, s.id)) AS slug,
            any_value(c.aliases) AS aliases, max(s.window_end) AS last_seen_at,
            min(row(s.window_start, s.id)) AS first_seq, max(row(s.window_start, s.id)) AS seq
        FROM summaries s LEFT JOIN catalog c ON c.id = s.entity_id
        GROUP BY s.entity_id""",
    "entity_map": """
        SELECT id, arg_min(id, first_seq) OVER (PARTITION BY entity_type, slug) AS entity_id
        FROM entity_folded""",
    "published_entities": """
        SELECT m.entity_id AS id, arg_max(f.entity_type, f.seq) AS entity_type,
            arg_max(f.canonical_name, f.seq) AS canonical_name, arg_max(f.slug, f.seq) AS slug,
            coalesce(arg_max(f.aliases, f.seq) FILTER (len(f.aliases) > 0), []) AS aliases,
            max(f.last_seen_at) AS last_seen_at
        FROM entity_folded f JOIN entity_map m ON m.id = f.id GROUP BY m.entity_id""",
    "popularity": f"""
        SELECT entity_id, canonical_name, entity_type, count(*) AS mention_count_24h,
            max(crawl_date) AS last_seen_at
        FROM (
            SELECT DISTINCT m.article_id, m.crawl_date, m.canonical_entity_id AS entity_id,
                coalesce(c.canonical_name, m.canonical_name) AS canonical_name,
                {entity_kind('coalesce(c.entity_type, m.label)')} AS entity_type
            FROM mentions m LEFT JOIN catalog c ON c.id = m.canonical_entity_id
            WHERE m.canonical_entity_id IS NOT NULL
                AND m.crawl_date >= {NOW} - INTERVAL 24 HOURS AND m.crawl_date < {NOW})
        GROUP BY ALL""",
    "active": f"""
        SELECT p.entity_id AS id, arg_max(p.entity_type, row(p.mention_count_24h, p.canonical_name, p.entity_type))
                AS entity_type,
            arg_max(p.canonical_name, row(p.mention_count_24h, p.canonical_name, p.entity_type)) AS canonical_name,
            arg_max({public_slug('p.canonical_name')}, row(p.mention_count_24h, p.canonical_name, p.entity_type))
                AS slug,
            coalesce(any_value(c.aliases), []) AS aliases,
            max(p.mention_count_24h) AS mention_count_24h, max(p.last_seen_at) AS last_seen_at
        FROM popularity p LEFT JOIN catalog c ON c.id = p.entity_id GROUP BY p.entity_id""",
    "active_live": """
        SELECT a.* FROM active a LEFT JOIN (
            SELECT n.id, min(n.id) OVER (PARTITION BY n.entity_type, n.slug) AS first_id
            FROM active n
            WHERE n.id NOT IN (SELECT id FROM published_entities)
            AND NOT EXISTS (SELECT 1 FROM published_entities p
                WHERE p.entity_type = n.entity_type AND p.slug = n.slug)) f ON f.id = a.id
        WHERE a.id IN (SELECT id FROM published_entities) OR f.id = f.first_id""",
    "entities": """
        SELECT coalesce(p.id, a.id) AS id, coalesce(p.entity_type, a.entity_type) AS entity_type,
            coalesce(p.canonical_name, a.canonical_name) AS canonical_name,
            coalesce(p.slug, a.slug) AS slug,
            CASE WHEN p.id IS NULL THEN a.aliases ELSE p.aliases END AS aliases,
            coalesce(a.mention_count_24h, 0) AS mention_count_24h,
            greatest(p.last_seen_at, a.last_seen_at) AS last_seen_at
        FROM published_entities p FULL JOIN active_live a ON a.id = p.id""",
    "item_rows": f"""
        SELECT s.id, m.entity_id, s.window_start, s.window_end, s.short_description AS title,
            s.aggregated_news AS summary, s.article_count, s.article_ids
        FROM summaries s JOIN entity_map m ON m.id = s.entity_id""",
    "items": """
        SELECT arg_min(id, row(window_start, id)) AS id, entity_id, window_start, window_end,
            arg_max(title, row(window_start, id)) AS title,
            arg_max(summary, row(window_start, id)) AS summary,
            arg_max(article_count, row(window_start, id)) AS article_count
        FROM item_rows GROUP BY entity_id, window_start, window_end""",
    "item_links": """
        SELECT timeline_item_id, entity_id, article_id,
            arg_max(position, row(window_start, id)) AS position
        FROM (
            SELECT i.id, i.entity_id, i.window_start, unnest(i.article_ids) AS article_id,
                unnest(range(len(i.article_ids))) AS position,
                arg_min(i.id, row(i.window_start, i.id))
                    OVER (PARTITION BY i.entity_id, i.window_start) AS timeline_item_id
            FROM item_rows i)
        GROUP BY timeline_item_id, entity_id, article_id""",
    "source_articles": f"""
        SELECT a.id, a.title, a.url, a.canonical_url, a.source_name, a.domain_name, a.description,
            a.published_time AS published_at, a.crawl_date AS crawled_at, a.content_hash,
            {public_slug('a.title')} || '-' || left(a.id, 8) AS slug,
            coalesce(nullif(c.filtered_content, ''), nullif(c.content, ''),
                nullif(a.description, ''), a.title) AS body,
            coalesce(nullif(a.description, ''), left(coalesce(nullif(c.filtered_content, ''),
                nullif(c.content, ''), nullif(a.description, ''), a.title), 240)) AS excerpt,
            a.language
        FROM articles a LEFT JOIN contents c ON c.id = a.id
        WHERE a.id IN (SELECT unnest(article_ids) FROM summaries)""",
}


def query(body: str) -> str:
    """``body`` preceded by the common tables it names, directly or not."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in _CTES:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                visit(_CTES[name])
                order.append(name)

    visit(body)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{name} AS MATERIALIZED ({_CTES[name]})" for name in order)
    return f"WITH {parts}\n{body.strip()}"
