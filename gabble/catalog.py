"""Parameter tables: who is tracked, and the fixed lists the rules use.

Everything here is a default argument somewhere else; nothing reads these names implicitly.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ENTITY_SCHEMA = (
    "persoon string, full_name string, description string, gender string, pronoun string, "
    "search_queries array<string>, title_variants array<string>, "
    "strict_variants array<string>, loose_variants array<string>"
)


@dataclass(frozen=True)
class Entity:
    """One tracked person.

    ``title_variants`` decide whether a thread is about the person, ``strict_variants`` whether a
    comment in any other thread names them, ``loose_variants`` feed the name flags of the cleaning
    step. Ambiguous surnames belong in the loose list only.
    """

    persoon: str
    full_name: str
    description: str
    gender: str
    pronoun: str
    search_queries: tuple[str, ...]
    title_variants: tuple[str, ...]
    strict_variants: tuple[str, ...]
    loose_variants: tuple[str, ...]


def entity_frame(spark: SparkSession, entities: Iterable[Entity]) -> DataFrame:
    """The catalog as a local relation.

    Spark then knows its exact size: it broadcasts a small catalog by itself and falls back to a
    shuffled join for a large one.
    """
    rows = [asdict(e) for e in entities]
    schema = StructType.fromDDL(ENTITY_SCHEMA)
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)), schema)


# --- Fixed values: results are only comparable while these stay as they are -----------------------

SKATERS = (
    Entity("ireen", "Ireen Wüst", "Ireen Wüst (Dutch long-track speed skater)", "vrouw", "she/her",
           ("Ireen Wust", "Ireen Wüst"),
           ("ireen wüst", "ireen wust"),
           ("ireen wüst", "ireen wust", "wüst", "wust"),
           ("ireen wust", "ireen wüst", "wust", "wüst")),
    Entity("femke", "Femke Kok", "Femke Kok (Dutch long-track speed skater)", "vrouw", "she/her",
           ("Femke Kok",), ("femke kok",), ("femke kok",), ("femke kok", "kok")),
    Entity("thomas", "Thomas Krol",
           "Thomas Krol (Dutch long-track speed skater) — NOT Thomas Müller the footballer",
           "man", "he/him",
           ("Thomas Krol",), ("thomas krol",), ("thomas krol", "krol"), ("thomas krol", "krol")),
    Entity("sven", "Sven Kramer", "Sven Kramer (Dutch long-track speed skater)", "man", "he/him",
           ("Sven Kramer",), ("sven kramer",), ("sven kramer",), ("sven kramer", "kramer")),
    Entity("jutta", "Jutta Leerdam", "Jutta Leerdam (Dutch long-track speed skater)",
           "vrouw", "she/her",
           ("Jutta Leerdam",), ("jutta leerdam",), ("jutta leerdam", "leerdam"),
           ("jutta leerdam", "leerdam")),
    Entity("kjeld", "Kjeld Nuis", "Kjeld Nuis (Dutch long-track speed skater)", "man", "he/him",
           ("Kjeld Nuis",), ("kjeld nuis",), ("kjeld nuis", "nuis", "kjeld"),
           ("kjeld nuis", "nuis")),
)

BOT_AUTHORS = (
    "AutoModerator", "automoderator", "[deleted]", "[removed]",
    "RemindMeBot", "WikiTextBot", "sneakpeekbot",
)

DELETED_BODIES = ("[deleted]", "[removed]")

DELETED_PHRASES = ("This post was mass deleted", "This comment was removed")

DELETED_WHOLE = (r"\[deleted\]", r"\[removed\]", r"\s*deleted\s*", r"\.\s*")

FOOTER_MARKER = "This post was mass deleted"
FOOTER_PATTERN = r"\n*\*?This post was mass deleted.*?\*?$"

CONTROL_PATTERN = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

FOLD_FROM, FOLD_TO = "üöäéèë", "uoaeee"

URL_PREFIX = "https://www.reddit.com"

SUBREDDIT_ALLOWLIST = (
    "Speedskating", "speedskatebabes", "JuttaLeerdam", "WinterOlympics2026",
    "MilanOlympics", "OlympicsV2", "olympics", "OlympicBornToday",
    "BeautifulOlympians", "HottestWinterAthletes", "dutchwomanathletes",
    "sports", "nextfuckinglevel", "Damnthatsinteresting", "interestingasfuck",
    "gifs", "coolguides", "Infographics",
    "NUjijDiscussies", "Nederland", "thenetherlands", "Netherlands",
    "Politiek", "PolitiekeMemes", "cirkeltrek", "taalfout", "DeStagiair",
    "tokkiefeesboek", "papgrappen", "HLNFails", "NLCelebs",
    "LAinfluencersnark", "sportsgossips", "ladyladyboners",
    "HottestFemaleAthletes", "ik_ihe", "pics",
)

GENERAL_SUBREDDITS = (
    "coolguides", "Infographics", "Damnthatsinteresting",
    "interestingasfuck", "nextfuckinglevel", "gifs", "sports",
)

OFF_TOPIC_SUBREDDITS = (
    "soccer", "fcbayern", "coys", "borussiadortmund", "Bundesliga",
    "feyenoord", "MCFC", "schalke04", "OlympiqueLyonnais", "futebol",
    "Eredivisie", "worldcup", "fcsp",
    "baseball", "minnesotatwins", "angelsbaseball", "Braves",
    "TOP5LEAGUESFM24SAVE", "FifaCareers", "WEPES", "UMF26",
    "indieheads", "byzantium", "Games", "DCcomics", "Wolverine",
    "CrusaderKings", "Magic", "oscarrace", "BareKnuckleFC",
    "generationology", "conspiracy",
)

#: Look-back periods in seconds; ``all`` means no lower bound.
PERIOD_SECONDS = {"all": None, "year": 31536000, "month": 2592000, "week": 604800, "day": 86400}

SCORE_THRESHOLD = 0.55
MAX_THREADS_PER_PERSON = 300
MAX_THREADS_PER_QUERY = 1000
MAX_COMMENTS_PER_THREAD = 500
LABEL_SAMPLE_SIZE = 10
MODEL_SAMPLE_SIZE = 16
SAMPLE_SEED = 42

RELEVANCE_LABELS = ("RELEVANT", "NOT_RELEVANT")

CONTEXT_FORMAT = "[Subreddit: r/%s | Thread: %s]\nComment: %s"
PROMPT_FORMAT = "Target skater: %s\nThread title: %s\nSubreddit: r/%s\nComment: %s\n\nJSON:"

EVALUATES_FORMAT = "this comment evaluates or describes %s (%s)"
EVALUATES_FULL_FORMAT = "this comment evaluates or describes %s, Dutch speed skater (%s)"
NOT_ABOUT_FORMAT = "this comment is not about %s or contains no evaluation"
NOT_ABOUT_FULL_FORMAT = "this comment is not about %s or contains no evaluation of %s"
ABOUT_FORMAT = "this comment is about %s as an athlete or person"
NOT_ABOUT_SIMPLE_FORMAT = "this comment is not about %s"

# --- Default lexicons of the rule scorers (own word lists, replace freely) -------------------------

NEGATIVE_WORDS = (
    "awful", "bad", "clown", "disappointing", "disgusting", "idiot", "loser", "moron", "overrated",
    "pathetic", "scum", "stupid", "terrible", "trash", "ugly", "weak", "worst", "worthless",
    "arrogant", "belachelijk", "dom", "slecht", "vreselijk", "zwak",
)
POSITIVE_WORDS = (
    "amazing", "beautiful", "best", "brilliant", "congratulations", "good", "great", "impressive",
    "incredible", "love", "proud", "strong", "talented", "wonderful",
    "geweldig", "goed", "knap", "mooi", "prachtig", "sterk", "trots",
)
SKATING_WORDS = (
    "skate", "skater", "skating", "speedskating", "schaatsen", "schaatser", "schaatsster", "ice",
    "ijs", "rink", "olympics", "olympic",
)
PERFORMANCE_WORDS = (
    "race", "medal", "gold", "silver", "bronze", "win", "won", "lost", "record", "result", "time",
    "training", "technique", "goud", "zilver", "brons", "wedstrijd", "tijd",
)
