"""Fixed values shared by all jobs.

These must stay equal across runs: ids are derived from the namespaces, and
results depend on the limits.
"""

# uuid5 namespaces.
NEWS_URL_NAMESPACE = "5f0d8d26-c499-4b2c-b390-83178a85d814"
ENTITY_NAMESPACE = "a5577179-7f6d-4f2e-8e6d-9671bfc68231"
SUMMARY_NAMESPACE = "c384e508-4e31-4e4b-a25e-e4782bbbe528"

# Time windows.
WINDOW_HOURS = 3
POPULARITY_HOURS = 24
WINDOW_SECONDS = WINDOW_HOURS * 3600

# Ranking limits.
TOP_ENTITIES_BY_TYPE = {"PLAYER": 50, "COACH": 30, "CLUB": 30}
ARTICLES_PER_ENTITY = 5

# Entity scores and chunking.
MODEL_THRESHOLD = 0.5
PERSIST_THRESHOLD = 0.95
CHUNK_WORDS = 300
CHUNK_OVERLAP = 40
CHUNK_LIMIT = 64
CHUNK_MAX_CHARS = 500_000

# Crawl policy.
MAX_AGE_DAYS = 30
CANDIDATE_LIMIT = 500
SCHEDULED_FETCH_LIMIT = 100
BOOTSTRAP_FETCH_LIMIT = 500
MIN_TEXT_LENGTH = 40

ENTITY_TYPES = ("PLAYER", "CLUB", "COACH", "COMPETITION")

# The pointer event.
CRAWLED_TOPIC = "news.crawled.v1"
CRAWLED_EVENT = "news.crawled"
CRAWLED_PRODUCER = "crawler-service"
CRAWLED_AGGREGATE = "news_article"
