"""Vocabularies that results depend on, in natural order."""

PAST_CANON = ("approved", "canonized")
CURRENT_CHECK = ("approved", "canonized", "suggested", "needs_review")
PREVIEW = ("suggested", "needs_review")
REPLACEABLE = ("suggested", "needs_review", "deprecated")

CLAIM_TYPES = (
    "character_trait", "character_goal", "character_state", "character_preference", "place_preference", "relationship_state",
    "relationship_change", "event", "world_rule", "power_rule", "timeline_fact", "plotline_fact",
)

ENTITY_TYPES = ("character", "animal", "place", "object", "concept", "group")

NEGATED = {"trusts": "distrusts", "trust": "distrust", "loves": "hates", "love": "hate", "likes": "dislikes", "like": "dislike"}
NEGATIVE = (
    "dislikes", "dislike", "distrusts", "distrust", "dreads", "dread", "fears", "fear", "feels fear", "hostile", "is hostile",
    "hostile to", "hates", "hate", "detests", "detest", "worries about", "worried about",
)
POSITIVE = (
    "likes", "like", "loves", "love", "trusts", "trust", "cares for", "cares", "is comfortable with", "comfortable with",
    "is relieved about", "relieved about",
)
MILD = ("is uncomfortable with", "uncomfortable with")
APPROACHING = ("running towards", "runs towards", "moves toward", "approaches", "seeks")
AVOIDING = ("running away from", "runs away from", "avoids", "avoiding", "fleeing")
OPPOSITES = (
    ("trusts", "distrusts"), ("trust", "distrust"), ("likes", "dislikes"), ("like", "dislike"), ("loves", "hates"), ("love", "hate"),
    ("loves", "detests"), ("love", "detest"), ("is alive", "is dead"), ("alive", "dead"), ("can", "cannot"),
)
EXCLUSIVE = ("is", "is from", "born in", "lives in", "lives at", "resides in", "works as", "is married to", "spouse of", "partner of", "moving to")
NOBODY = ("nobody", "no one", "none", "nothing", "no-one")
EXPLICIT_DISTRUST = ("distrust", "did not trust", "does not trust", "don't trust", "didn't trust", "could not trust", "couldn't trust")

LOCATION_KEYS = ("lives in", "lives at", "resides in", "resides at", "located in", "located at", "moving to", "is from", "born in")
INSTITUTION = r"\b(?:school|high school|college|university|hospital|church|office|station|library|gym|cafeteria|classroom)\b"
RESIDENCE = r"\b(?:house|home|apartment|flat|condo|mansion|cottage|hotel|motel|residence|dwelling|cabin|trailer|room|bedroom|kitchen|porch|chief'?s)\b"
OWN_RESIDENCE = r"\b\w+(?:'s|’s)\s+(?:house|home|place|apartment|cottage)\b"
ROOM = r"\b(?:room|bedroom|kitchen)\b"
REGION = r"\b(?:state|country|nation|peninsula|county|province|territory)\b"
#: Each match of the patterns above holds one of these.
INSTITUTION_WORDS = ("school", "college", "university", "hospital", "church", "office", "station", "library", "gym", "cafeteria", "classroom")
RESIDENCE_WORDS = (
    "house", "home", "apartment", "flat", "condo", "mansion", "cottage", "hotel", "motel", "residence", "dwelling", "cabin", "trailer",
    "room", "kitchen", "porch", "chief",
)
REGION_WORDS = ("state", "country", "nation", "peninsula", "county", "province", "territory")
GRANULARITY_RANK = {"room": 1, "residence": 2, "institution": 2, "city": 3, "region": 4, "unknown": 0}
#: A default that callers replace by the places of their own stories.
KNOWN_PLACES = ("stonefield", "riverton", "harrowgate")

PREDICATE_ALIASES = {
    "love": "loves", "loves": "loves", "loved": "loves", "hate": "hates", "hates": "hates", "hated": "hates", "trust": "trusts",
    "trusts": "trusts", "trusted": "trusts", "distrust": "distrusts", "distrusts": "distrusts", "distrusted": "distrusts",
    "fear": "fears", "fears": "fears", "feared": "fears", "desire": "desires", "desires": "desires", "desired": "desires",
}
TRANSITIONS = (
    "trusts", "distrusts", "loves", "hates", "fears", "misses", "partner_of", "married_to", "boyfriend_of", "girlfriend_of",
    "cares_for", "lives_in", "lives_at", "located_in",
)
INFERRED = (
    "distrusted", "distrusts", "distrust", "trusted", "trusts", "trust", "loved", "loves", "hated", "hates", "cannot be killed",
    "interacts with", "speaks with",
)
TYPE_PREDICATE = {
    "relationship_state": "relates_to", "relationship_change": "relates_to", "character_state": "is", "character_trait": "has_trait",
    "character_goal": "seeks", "character_preference": "prefers", "place_preference": "feels_about_place", "event": "interacts_with",
    "world_rule": "governed_by", "power_rule": "has_power", "timeline_fact": "occurred", "plotline_fact": "involves",
}

GROUPS = {
    "romantic": ("loves", "loved", "desires", "desired", "obsessed_with", "longs_for"),
    "trust": ("trusts", "trusted", "distrusts", "distrusted"),
    "rivalry": ("hates", "hated", "rivals", "is_enemy_of", "betrays", "betrayed"),
    "family": ("is_half_brother_of", "daughter_of", "son_of", "mother_of", "father_of"),
    "mentorship": ("mentors", "mentored", "protects", "protected"),
    "social": (
        "is_friend_of", "speaks_with", "looks_at", "watches", "stares_at", "glances_at", "relates_to", "knows", "partner_of",
        "bought_gift_for", "cares_for", "awkward_with",
    ),
}
CANON_WEIGHT = {"core": 1.2, "active": 1.0, "soft": 0.75}
STATUS_RANK = {"canonized": 4, "approved": 3, "needs_review": 2, "suggested": 1}

# Extraction from prose: fixed values.
EMOTIONS = {
    "love": "loves", "loves": "loves", "loved": "loves", "detest": "detests", "detests": "detests", "detested": "detests",
    "hate": "hates", "hates": "hates", "hated": "hates", "miss": "misses", "misses": "misses", "missed": "misses",
    "trust": "trusts", "trusts": "trusts", "trusted": "trusts", "distrust": "distrusts", "distrusts": "distrusts",
    "distrusted": "distrusts", "fear": "fears", "fears": "fears", "feared": "fears", "care for": "cares_for",
    "cared for": "cares_for", "worry about": "worries_about", "worried about": "worries_about",
}
AUXILIARIES = ("did", "do", "does", "could", "would", "should", "had", "have", "has", "was", "were", "am", "are", "is", "will", "can")
CLAUSE_BREAKS = ("when", "because", "since", "though", "if", "as", "while", "where", "who", "that", "but", "and", "or")
TAIL_WORDS = (
    "in", "on", "at", "to", "from", "with", "for", "and", "or", "the", "a", "an", "deeply", "truly", "really", "still", "even", "also",
    "just", "very", "all", "either", "anymore", "too", "yet",
)
NOT_NAMES = (
    "the", "a", "an", "it", "he", "she", "they", "we", "i", "but", "and", "or", "then", "when", "while", "after", "before", "there",
    "here", "his", "her", "their", "my", "your", "what", "who", "how", "why", "if", "as", "in", "on", "at", "to", "from", "with", "for",
    "not", "no", "yes", "oh", "ah", "well", "so", "just", "still", "even", "all", "one", "two", "three", "chapter", "part", "section",
    "you", "me",
)
LEADING_FILLERS = (
    "way", "that", "how", "in", "a", "an", "the", "and", "but", "so", "as", "if", "when", "while", "after", "before", "then", "just",
    "even", "still", "also", "only", "not",
)
FIRST_PERSON = ("i", "me", "myself")
PLACEHOLDERS = ("narrator", "i", "me", "myself", "my", "mine")
PRONOUNS = ("i", "me", "you", "he", "she", "they", "we", "us", "him", "her", "them", "my", "your", "his", "their", "it")
JUNK_STARTS = ("tell", "of", "you", "this", "that", "when", "what", "how", "flying", "neither", "nothing", "police", "chief")
AUXILIARY_STARTS = (
    "did", "does", "do", "was", "were", "had", "have", "has", "is", "are", "am", "will", "would", "could", "should", "can", "not", "never",
)
JUNK_OBJECTS = (
    "wide", "blue", "cheap", "good", "great", "old", "new", "the vigorous", "her wide", "me before", "me", "loved", "detested", "the sun and",
)
GERUNDS = ("getting", "being", "having", "making", "taking", "going", "doing")
GERUND_ENDS = ("full", "ready", "better", "worse", "started", "done", "back", "up", "down", "out", "in", "off")
KINSHIP = ("daughter_of", "son_of", "mother_of", "father_of")
WEAK_SPEECH = ("speaks_with", "said_to", "tells", "asks", "whispers_to", "looks_at", "watches", "stares_at", "glances_at")
FAMILIES = {
    "love": ("loves", "loved", "love"),
    "hate": ("detests", "detest", "detested", "hates", "hated", "hate"),
    "trust": ("trusts", "trusted"),
    "distrust": ("distrusts", "distrusted"),
    "fear": ("fears", "feared", "fear"),
    "miss": ("misses", "missed", "miss"),
}
NEGATIONS = ("not", "never", "n't", "no", "neither", "without")
ORIGIN_RANK = {"fastus": 4, "structural": 3, "family": 3, "llm": 2, "llm_recall": 1, "heuristic": 0}

# Entity typing: fixed values.
CONCEPTS = (
    "water", "rain", "darkness", "light", "love", "fear", "hope", "memory", "dream", "death", "life", "time", "sun", "moon", "wind",
    "fire", "ice", "snow", "stone", "gold", "silver", "power", "magic", "truth", "silence", "chaos", "peace", "war", "blood", "shadow",
    "lightning", "thunder", "the sea", "the ocean", "the sky", "the night", "the day", "the world", "the land", "the forest",
    "the river", "the mountain", "heat", "the heat", "clouds", "cloud", "awkwardness", "the rain",
)
OBJECTS = (
    "parka", "carry-on", "carry on", "cruiser", "car", "truck", "chevy", "engine", "wardrobe", "winter wardrobe", "airport", "plane",
    "lights", "red and blue lights", "the thing", "gift", "homecoming gift", "mechanic", "traffic", "ferns", "moss", "trees",
)
PLACE_ENDS = (
    " city", " kingdom", " hall", " castle", " tower", " beach", " shack", " village", " town", " land", " island", " forest",
    " mountains", " valley",
)
ANIMALS = (
    "dog", "horse", "dragon", "wolf", "cat", "bird", "serpent", "snake", "bear", "lion", "tiger", "raven", "eagle", "hawk", "stag",
    "deer", "fox", "hound",
)
GROUP_WORDS = (
    "army", "soldiers", "guards", "villagers", "crowd", "people", "wildlings", "knights", "men", "women", "children", "elders",
    "priests", "rebels",
)
HUMAN_ROLES = (
    "man", "woman", "boy", "girl", "child", "king", "queen", "lord", "lady", "prince", "princess", "stranger", "husband", "wife",
    "mother", "father", "brother", "sister", "son", "daughter", "uncle", "aunt", "captain", "general", "knight", "servant", "maid",
    "butler", "merchant", "priest", "witch", "wizard", "assassin", "guard", "soldier",
)
PARENTS = ("mom", "mother", "mum", "dad", "father", "pa")
PLACE_WORDS = ("city", "kingdom", "castle", "hall", "beach", "village", "island")
NEVER_NAMES = (
    "you", "i", "we", "they", "he", "she", "it", "this", "that", "there", "here", "when", "what", "how", "of", "tell", "don", "flying",
    "neither", "nothing", "police", "chief",
)
RELATIONAL = (
    "loves", "loved", "love", "hates", "hated", "hate", "detests", "detested", "detest", "fears", "feared", "fear", "trusts", "trusted",
    "trust", "distrusts", "distrusted", "misses", "missed", "miss", "cares_for", "cared_for", "worries_about", "worried_about",
    "desires", "desired", "wants", "wanted", "needs", "needed", "longs_for", "obsessed_with", "betrays", "betrayed", "daughter_of",
    "son_of", "mother_of", "father_of", "partner_of", "knows", "bought_gift_for", "awkward_with",
)
NAME_STOPWORDS = ("the", "of", "a", "an", "my", "her", "his", "their", "mr", "mrs", "ms", "dr")

# Candidates from prose: fixed values.
KIN_TERMS = (
    "father", "mother", "dad", "mom", "mum", "pa", "papa", "daddy", "mama", "mommy", "mammy", "parent", "parents", "son", "daughter",
    "child", "children", "brother", "sister", "sibling", "grandfather", "grandmother", "grandpa", "grandma", "granny", "nan", "nana",
    "grandson", "granddaughter", "grandchild", "uncle", "aunt", "auntie", "nephew", "niece", "cousin", "husband", "wife", "spouse",
    "fiance", "fiancée", "partner", "boyfriend", "girlfriend", "lover", "sweetheart", "stepfather", "stepmother", "stepdad", "stepmom",
    "stepson", "stepdaughter", "stepbrother", "stepsister", "stepparent", "stepchild", "father-in-law", "mother-in-law",
    "brother-in-law", "sister-in-law", "son-in-law", "daughter-in-law", "in-law", "guardian", "ward", "adoptive father",
    "adoptive mother", "adoptive parent", "adopted son", "adopted daughter", "adopted child", "foster father", "foster mother",
    "foster parent", "foster son", "foster daughter", "foster child",
)
#: Terms told by another's name; the others are their own, hyphens as underscores.
KIN_SAME = {
    "dad": "father", "pa": "father", "papa": "father", "daddy": "father", "mom": "mother", "mum": "mother", "mama": "mother",
    "mommy": "mother", "mammy": "mother", "parents": "parent", "children": "child", "grandpa": "grandfather", "grandma": "grandmother",
    "stepdad": "stepfather", "stepmom": "stepmother",
}
FEELINGS = (
    "afraid", "jealous", "angry", "furious", "sad", "happy", "confused", "worried", "anxious", "embarrassed", "ashamed", "proud", "lonely",
    "heartbroken", "devoted", "resentful", "grateful", "uncomfortable", "comfortable", "curious", "hopeful", "suspicious", "fearful",
)
FELT_FOR = ("uncomfortable", "jealous", "angry", "afraid", "suspicious", "curious", "happy", "sad")
FELT_VERBS = ("trust", "trusted", "love", "loved", "hate", "hated", "fear", "feared", "miss", "missed", "distrust", "distrusted")
NARRATING = ("i", "me", "myself", "my", "mine")
THIRD_PERSON = ("he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs")
OBJECT_FILLERS = ("at", "all", "either", "anymore", "too", "yet", "still", "even", "just")
TIME_MARKS = r"(?iU)\b(?:yesterday|today|tomorrow|last\s+(?:night|week|month|year|summer|winter)|next\s+(?:day|week|month|year)|before|after|when|then|always|years?\s+ago)\b"
