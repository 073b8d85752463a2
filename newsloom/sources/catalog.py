"""The news sources and the entity catalog file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import catalog

# Article path patterns by source (lower-case path, no trailing /).
ARTICLE_PATTERNS = [
    ("ESPN Soccer", "/soccer/story/_/id/", None),
    ("Transfermarkt", "/view/news/", None),
    ("Reuters Soccer", "^/sports/soccer/", None),
    ("Premier League", "^/en/news/", None),
    ("Sky Sports Football", "^/football/(news|live-blog)/", None),
    ("Associated Press Soccer", "^/article/", None),
    ("FIFA News", "/news/", "/tournaments/mens/worldcup/canadamexicousa2026/"),
    (
        "FIFA World Cup News",
        "(?=.*/tournaments/mens/worldcup/canadamexicousa2026/)(?=.*/articles/)",
        None,
    ),
]
# Fixed value: sources that publish articles below /articles/ only.
ARTICLES_PATH = "/articles/"

SOURCE_COLUMNS = (
    "source_name STRING, url STRING, source_type STRING, allowed_domains ARRAY<STRING>,"
    " enabled BOOLEAN, requires_article_path BOOLEAN"
)


def select_sources(sources: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The named sources, or those enabled by default."""
    if names:
        return sources.filter(F.col("source_name").isin(*names))
    return sources.filter("enabled")


def article_rules(sources: DataFrame) -> DataFrame:
    """Article pattern per source: the path flag, the broadcaster name, else the table."""
    known = sources.sparkSession.createDataFrame(
        ARTICLE_PATTERNS, "source_name STRING, include STRING, exclude STRING"
    )
    flagged = F.col("requires_article_path") | F.contains(F.lower("source_name"), F.lit("bbc"))
    return sources.join(known, "source_name", "left").select(
        "source_name",
        F.when(flagged, F.lit(ARTICLES_PATH)).otherwise(F.col("include")).alias("include"),
        F.when(~flagged, F.col("exclude")).alias("exclude"),
    )


CATALOG_FILE = "season STRING, leagues MAP<STRING, ARRAY<STRUCT<club: STRING, alias: ARRAY<STRING>>>>"


def read_alias_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a nested alias catalog file: league, season, club, alias."""
    document = spark.read.schema(CATALOG_FILE).json(path, multiLine=True)
    return (
        document.select("season", F.explode("leagues").alias("league", "clubs"))
        .select("season", "league", F.explode("clubs").alias("c"))
        .select("league", "season", "c.club", "c.alias")
    )


def load_alias_catalog(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Catalog documents of a file; conflicts are reported by ``alias_conflicts``."""
    return catalog.catalog_documents(read_alias_catalog(spark, path), source=path, now=now)


# The known sources (name, url, type, domains, on by default, article path only).
KNOWN_SOURCES = [
    ("BBC Sport - Premier League", "https://feeds.bbci.co.uk/sport/football/premier-league/rss.xml", "RSS", ["bbci.co.uk", "bbc.co.uk", "bbc.com"], True, True),
    ("BBC Sport - Champions League", "https://feeds.bbci.co.uk/sport/football/champions-league/rss.xml", "RSS", ["bbci.co.uk", "bbc.co.uk", "bbc.com"], True, True),
    ("BBC Sport - Europa League", "https://feeds.bbci.co.uk/sport/football/europa-league/rss.xml", "RSS", ["bbci.co.uk", "bbc.co.uk", "bbc.com"], True, True),
    ("BBC Sport - FA Cup", "https://feeds.bbci.co.uk/sport/football/fa-cup/rss.xml", "RSS", ["bbci.co.uk", "bbc.co.uk", "bbc.com"], True, True),
    ("BBC Sport - League Cup", "https://feeds.bbci.co.uk/sport/football/league-cup/rss.xml", "RSS", ["bbci.co.uk", "bbc.co.uk", "bbc.com"], True, True),
    ("BBC Sport - World Cup", "https://feeds.bbci.co.uk/sport/football/world-cup/rss.xml", "RSS", ["bbci.co.uk", "bbc.co.uk", "bbc.com"], True, True),
    ("BBC Sport - European", "https://feeds.bbci.co.uk/sport/football/european/rss.xml", "RSS", ["bbci.co.uk", "bbc.co.uk", "bbc.com"], True, True),
    ("BBC Sport - Football RSS", "https://feeds.bbci.co.uk/sport/football/rss.xml", "RSS", ["bbci.co.uk", "bbc.co.uk", "bbc.com"], True, True),
    ("The Guardian Football", "https://www.theguardian.com/football/rss", "RSS", ["theguardian.com"], True, False),
    ("The Athletic Football", "https://www.nytimes.com/athletic/rss/football/", "RSS", ["nytimes.com"], True, False),
    ("The Telegraph Football", "https://www.telegraph.co.uk/football/sitemap-0.xml", "SITEMAP", ["telegraph.co.uk"], True, False),
    ("The Independent Football", "https://www.independent.co.uk/sport/football/rss", "RSS", ["independent.co.uk"], True, False),
    ("Reuters Soccer", "https://www.reuters.com/sports/soccer/", "HTML", ["reuters.com"], False, False),
    ("ESPN Soccer", "https://www.espn.com/soccer/", "HTML", ["espn.com"], False, False),
    ("Sky Sports Football", "https://www.skysports.com/football", "HTML", ["skysports.com"], False, False),
    ("Transfermarkt", "https://www.transfermarkt.co.uk/aktuell/newsarchiv", "HTML", ["transfermarkt.co.uk"], False, False),
    ("Associated Press Soccer", "https://apnews.com/hub/soccer", "HTML", ["apnews.com"], False, False),
    ("Premier League", "https://www.premierleague.com/en/news", "HTML", ["premierleague.com"], False, False),
    ("UEFA News", "https://www.uefa.com/news-media/", "HTML", ["uefa.com"], False, False),
    ("FIFA News", "https://www.fifa.com/sitemap", "SITEMAP", ["fifa.com"], False, False),
    ("FIFA World Cup News", "https://www.fifa.com/sitemap?scope=worldcup2026", "SITEMAP", ["fifa.com"], False, False),
]


def default_sources(spark: SparkSession) -> DataFrame:
    """The source catalog as rows of ``SOURCE_COLUMNS``."""
    return spark.createDataFrame(KNOWN_SOURCES, SOURCE_COLUMNS)
