"""Explicit schemas of every landed or stored table (DDL strings)."""

COMMENT_FIELDS = (
    "url", "author", "date", "timestamp", "score", "upvotes", "downvotes", "golds", "comment",
    "comment_id", "thread_url", "thread_title", "subreddit", "persoon", "gender",
)

COMMENTS = (
    "url string, author string, date string, timestamp bigint, score bigint, upvotes bigint, "
    "downvotes bigint, golds bigint, comment string, comment_id string, thread_url string, "
    "thread_title string, subreddit string, persoon string, gender string"
)

LABEL_SHEET = (
    "persoon string, gender string, subreddit string, comment string, manual_label string, "
    "model_deberta string, model_gpt string, model_claude string"
)

LISTING_PAGE = (
    "query_index int, persoon string, cursor string, data struct<children: array<struct<data: struct<"
    "permalink: string, title: string, subreddit: string, id: string, score: bigint>>>, "
    "after: string>"
)

FLAT_LISTING_PAGE = (
    "data array<struct<permalink: string, title: string, subreddit: string, id: string, "
    "author: string>>"
)

FLAT_COMMENT_PAGE = (
    "data array<struct<body: string, author: string, score: bigint, created_utc: double, "
    "id: string, link_id: string>>"
)

RELEVANCE_RESULTS = (
    "comment_id string, persoon string, label string, confidence string, reason string, raw string"
)
