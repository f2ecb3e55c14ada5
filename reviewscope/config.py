"""Parameters of every operator, in one place.

Fixed values: thresholds, label order, seed words and penalty weights below are part of
the result contract; change them per call, not here.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: column contract -------------------------------------------------
NUMERIC_COLUMNS = (
    "playtime_forever",
    "num_games_owned",
    "num_reviews",
    "votes_up",
    "votes_funny",
    "weighted_vote_score",
    "comment_count",
)
REQUIRED_COLUMNS = NUMERIC_COLUMNS + ("steam_purchase", "review")

# --- fixed values: emotion labels (order is the index of every probability vector) ----
EMOTIONS = ("joy", "sadness", "anger", "fear", "surprise", "love")
POSITIVE_EMOTIONS = ("joy", "love", "surprise")
NEGATIVE_EMOTIONS = ("sadness", "anger", "fear")
UNKNOWN = "unknown"
PENALTY_WEIGHT = 0.3

# --- fixed values: aspect seed words -----------------------------------------------
ASPECT_SEEDS = {
    "gameplay": (
        "gameplay", "mechanics", "controls", "playing", "fun", "combat", "difficulty", "challenge",
        "progression", "flow", "satisfying", "engaging", "addictive",
    ),
    "graphics": (
        "graphics", "visuals", "art", "beautiful", "stunning", "style", "design", "textures", "animations",
        "lighting", "detailed", "aesthetic",
    ),
    "performance": (
        "performance", "fps", "lag", "smooth", "optimization", "crashes", "bugs", "stable", "loading",
        "technical", "issues",
    ),
    "content": (
        "story", "content", "length", "narrative", "replay", "variety", "depth", "characters", "plot",
        "ending", "quests",
    ),
    "audio": (
        "sound", "music", "audio", "voice", "soundtrack", "effects", "immersive",
    ),
    "value": (
        "price", "worth", "value", "money", "expensive", "cheap", "cost",
    ),
}
FALLBACK_KEYWORDS = 5

# English function words removed before terms are counted.  A parameter of the text
# operators: pass another list to follow another library's choice.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "could", "did",
    "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into",
    "is", "it", "its", "itself", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off",
    "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she",
    "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was",
    "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would",
    "you", "your", "yours", "yourself", "yourselves",
)

# Frequent function words per language, used to guess a language when no column names it.
LANGUAGE_PROFILES = {
    "en": (
        "the", "of", "and", "to", "is", "that", "it", "for", "with", "was", "are", "this", "be", "at", "from",
    ),
    "fr": (
        "le", "la", "les", "des", "et", "est", "une", "que", "qui", "dans", "pour", "pas", "sur", "avec",
        "elle",
    ),
    "de": (
        "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "für", "den", "von", "auf", "auch",
        "sich",
    ),
    "es": (
        "el", "los", "las", "que", "en", "una", "por", "con", "para", "del", "se", "su", "como", "más", "pero",
    ),
}


@dataclass(frozen=True)
class CredibilityThresholds:
    """Literals of the nine credibility rules."""

    r1_playtime: float = 10
    r1_score: float = 0.95
    r2_games: float = 500
    r2_playtime: float = 30
    r3_reviews: float = 50
    r3_votes: float = 1
    r4_score: float = 0.97
    r4_playtime: float = 15
    r5_quantile: float = 0.98
    r6_comments: float = 10
    r6_funny: float = 100
    r6_score: float = 0.1
    r7_minutes: int = 5
    r8_reviews: float = 20
    r8_per_day: float = 5
    r9_reviews: float = 30
    r9_ratio: float = 0.1
    gate_rows: int = 1000
    neighbours: int = 7


@dataclass(frozen=True)
class QualityGates:
    """Volume limits of the two entry points."""

    refuse_below: int = 500
    warn_below: int = 1000
    strict_refuse_below: int = 1000
    strict_warn_upto: int = 2500
    fake_rate: float = 0.1
    credible_below: int = 1000


@dataclass(frozen=True)
class SentimentCuts:
    """Confidence cuts: aspects keep `>=`, topics keep `>`."""

    aspect_confidence: float = 0.6
    topic_confidence: float = 0.6
    topic_relevance: float = 0.1


CREDIBILITY = CredibilityThresholds()
GATES = QualityGates()
CUTS = SentimentCuts()
