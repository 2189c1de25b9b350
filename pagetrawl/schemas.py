"""Table schemas and the fixed values shared by the operators."""

from pyspark.sql import types as T

RAW_PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

PAGES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("indexed_at", T.StringType()),
    T.StructField("indexed_time", T.DoubleType()),
    T.StructField("backlinks", T.LongType()),
])

BACKLINKS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("target_url", T.StringType()),
    T.StructField("created_at", T.DoubleType()),
])

LINK_COUNTS = T.StructType([
    T.StructField("target_url", T.StringType()),
    T.StructField("backlinks", T.LongType()),
])

IMAGES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("alt_text", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("dominant_color", T.StringType()),
    T.StructField("indexed_at", T.StringType()),
])

HISTORY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
])

CLEARED = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("upto", T.LongType()),
])

SEEDS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("source", T.StringType()),
])

RUN_LOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("start_url", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("pages_crawled", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("triggered_by", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("time_str", T.StringType()),
])

COLLECTION_PAGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("backlinks", T.LongType()),
    T.StructField("indexed_at", T.StringType()),
    T.StructField("likes", T.LongType()),
])

COLLECTIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("pages", T.ArrayType(COLLECTION_PAGE)),
])

# Limits that decide which rows an operator returns.
MAX_LINKS = 15
MAX_IMAGES = 12
SNIPPET_CHARS = 160
CANDIDATE_CAP = 200
IMAGE_SCAN_CAP = 100
IMAGE_LIMIT = 12
PAGE_SIZE = 10
SUGGESTIONS = 5
MAX_EDITS = 2
HISTORY_LIMIT = 20
MRU_LIMIT = 10
RUNS_LIMIT = 15
CRAWL_DEPTH = 3
BM25_K1 = 1.2
BM25_B = 0.75

# Endings of URL paths that are not pages.
NON_PAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".pdf", ".zip"]

# Marks of layout and tracking images.
NOISE_IMAGE_MARKS = ["spacer", "tracking", "analytics"]

# Display order of the colour facets.
PALETTE = [
    "red", "orange", "yellow", "green", "teal", "blue",
    "purple", "pink", "brown", "white", "black",
]

# Colours picked by URL hash, in index order.
HASH_COLOURS = [
    "red", "orange", "yellow", "green", "blue", "purple",
    "pink", "white", "black", "teal", "brown",
]

# Colour keywords, the first colour with a match wins.
COLOUR_KEYWORDS = {
    "pink": ["cherry", "blossom", "sakura", "pink"],
    "purple": ["lavender", "purple", "violet"],
    "yellow": ["sunflower", "yellow", "banana", "gold"],
    "red": ["rose", "red", "strawberry", "fire"],
    "orange": ["ginger", "orange", "autumn", "carrot"],
    "teal": ["teal", "cyan", "turquoise"],
    "green": ["green", "forest", "grass", "leaves", "meadow", "fern"],
    "blue": ["blue", "waterfall", "ocean", "river", "sky", "lake", "sea", "nebula"],
    "white": ["white", "snow", "tulip", "clean"],
    "black": [
        "black", "dark", "space", "starry", "night", "silicon",
        "hardware", "motherboard", "ide", "editor",
    ],
    "brown": ["workbell", "wood", "brown", "desk"],
}

# Topics looked for in an image query, the first match wins.
TOPICS = ["flower", "cat", "dog", "space", "tech", "nature"]
DEFAULT_TOPIC = "nature"

# Further words for a topic, used by the wide topic rule.
TOPIC_SYNONYMS = {
    "flower": ["flower"],
    "cat": ["cat"],
    "dog": ["dog"],
    "space": ["space", "planet", "star", "galaxy"],
    "tech": ["tech", "code", "computer", "hardware", "silicon"],
}

# Seeds used when no seed is known.
DEFAULT_SEEDS = [
    ("https://news.ycombinator.com", "news.ycombinator.com", "whois"),
    ("https://www.wikipedia.org", "wikipedia.org", "whois"),
    ("https://archive.org", "archive.org", "whois"),
]

# Defaults of the crawl schedule.
DEFAULT_START_URL = "https://news.ycombinator.com"
DEFAULT_INTERVAL = "daily"

# Defaults of image records.
DEFAULT_IMAGE_TITLE = "Scraped Image"
DEFAULT_IMAGE_NAME = "Indexed Image"
DEFAULT_IMAGE_SOURCE = "https://en.wikipedia.org"
DEFAULT_NODE_SNIPPET = "No additional cache context parsed in Firestore index."

# English stop words of the text analyser.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from",
    "have", "if", "in", "is", "it", "may", "not", "of", "on", "or", "tbd",
    "that", "the", "this", "to", "us", "we", "when", "will", "with", "yet",
    "you", "your",
]
MIN_TERM_CHARS = 2
