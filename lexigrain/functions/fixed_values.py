"""Fixed values that results depend on."""

# The English stop words that Spark ships as its default list.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

# The age labels in numeric order, whose position is the label code.
AGE_LABELS = ["10s", "20s", "30s", "40s", "50s", "60s", "70s", "80s", "90s", "100s", "110s"]

# Labels merged into "70s" when rare old ages are combined.
RARE_AGE_LABELS = ["80s", "90s", "100s", "110s"]
MERGED_AGE_LABEL = "70s"

# Character classes. WORD is what Python's \w accepts; SPACE is what its \s accepts.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"

# An optional @ or #, then words joined by - ' . or .'
TOKEN_PATTERN = f"[@#]?(?:(?:[{WORD}]+(?:-|'|[.]|[.]'))+[{WORD}]+|[{WORD}]+)"

# Words with an inner apostrophe, or any other single visible character.
WORD_OR_MARK_PATTERN = f"[{WORD}]+(?:'[{WORD}]+)?|[^{WORD}{SPACE}]"

# Tokens of at least two word characters.
TWO_CHARACTER_PATTERN = f"[{WORD}]{{2,}}"

# Settings of the baseline run.
BASELINE = {
    "top_tokens": 50,
    "top_features": 150,
    "components": 20,
    "max_depth": 20,
    "trees": 50,
    "seed": 42,
}

# The grid that the hyper-parameter search runs over.
SEARCH_GRID = {
    "top_tokens": [5, 10, 15, 20, 30, 50],
    "top_features": [50, 100, 150, 500],
    "components": [20, 50, 100],
    "max_depth": [10, 20, 30, 50],
    "trees": [50],
}
