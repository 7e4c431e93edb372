"""Word lists, patterns and lookup tables that define results."""

POSITIVE_WORDS = ("good", "great", "excellent", "amazing", "wonderful", "best", "better", "positive", "happy")
NEGATIVE_WORDS = ("bad", "terrible", "awful", "worst", "worse", "negative", "sad", "unhappy", "poor")

NEGATIONS = ("not", "no", "never", "nothing", "nowhere", "neither", "nor")

# words that stay although they are common
KEPT_WORDS = (
    "not", "no", "never", "very", "too", "more", "less", "most", "least", "good", "bad", "great",
    "terrible", "awesome", "awful", "excellent", "poor", "best", "worst", "better", "worse",
)

INTENSIFIERS = {
    "very": "INT_", "really": "INT_", "extremely": "INT_", "incredibly": "INT_",
    "somewhat": "DIM_", "slightly": "DIM_", "barely": "DIM_",
}

# order matters
CONTRACTIONS = (
    ("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'s", " is"),
    ("'d", " would"), ("'ll", " will"), ("'t", " not"), ("'ve", " have"), ("'m", " am"),
)

# common English words without content
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below "
    "between both but by can did do does doing don down during each few for from further had has have "
    "having he her here hers herself him himself his how i if in into is it its itself just me more most "
    "my myself no nor not now of off on once only or other our ours ourselves out over own same she should "
    "so some such than that the their theirs them themselves then there these they this those through to "
    "too under until up very was we were what when where which while who whom why will with you your yours "
    "yourself yourselves"
).split()

# code-point ranges treated as emoji
EMOJI_CLASS = "[\\x{1F1E6}-\\x{1F1FF}\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B50}\\x{2B55}\\x{FE0F}\\x{200D}]"

URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
HTML_TAG = r"<[^>]+>"
BYLINE = r"(?i)^By\s+[\w\s]+$"
DATELINE = r"^[A-Z]+\s*[—-]\s*"
USER_MENTION = r"u/[\w-]+"
SUBREDDIT_MENTION = r"r/[\w-]+"
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
BOLD_ITALIC = r"\*{1,3}([^\*]+)\*{1,3}"
CODE_BLOCK = r"`{1,3}([^`]+)`{1,3}"
QUOTE_BLOCK = r"^>[^\n]*\n?$"
SPOILER = r"!>([^>]+)!<"

# one white-space sign, one word sign, in a form every regular-expression engine reads alike
SPACE_SIGNS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\p{Z}"
WORD_SIGNS = r"\p{L}\p{N}_"

# abbreviation -> zone, in the order in which they are looked for
TIMEZONE_ABBREVIATIONS = (
    ("UTC|GMT", "UTC"), ("EST|EDT|Eastern", "US/Eastern"), ("CST|CDT|Central", "US/Central"), ("MST|MDT|Mountain", "US/Mountain"),
    ("PST|PDT|Pacific", "US/Pacific"), ("AEST|AEDT", "Australia/Sydney"), ("ACST|ACDT", "Australia/Adelaide"),
    ("AWST", "Australia/Perth"), ("CET|CEST", "Europe/Paris"), ("EET|EEST", "Europe/Athens"),
    ("WET|WEST", "Europe/Lisbon"), ("IST", "Asia/Kolkata"), ("JST", "Asia/Tokyo"), ("KST", "Asia/Seoul"),
)

DATETIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy",
)

# formats tried when the type of a column is inferred
INFERENCE_FORMATS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm",
    "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm",
)
