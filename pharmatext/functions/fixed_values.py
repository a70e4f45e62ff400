"""They must equal the published lists and formats for results to be right."""

# English stop list, 179 entries.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will "
    "just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn "
    "didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn "
    "mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn "
    "wouldn't"
).split()

# Universal part-of-speech tags, plus SPACE.
POS_TAGS = (
    "ADJ ADP ADV AUX CONJ CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X SPACE"
).split()

# Strings that a CSV reader of the pandas family takes for a missing value.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Review sites and the start of their review-page addresses.
SITE_PREFIXES = {
    "webmd": "https://www.webmd.com/drugs/drugreview-",
    "drugs": "https://www.drugs.com/comments/",
    "everydayhealth": "https://www.everydayhealth.com",
    "drugratingz": "https://www.drugratingz.com/reviews/",
}

# Names of the star ratings on the two sites that have several per review.
WEBMD_STARS = ["effectiveness", "ease of use", "satisfaction"]
DRUGRATINGZ_STARS = ["effectiveness", "no side effects", "convenience", "value"]

# Reviews per page.
PAGE_SIZE = {"webmd": 5, "drugs": 25}

# What the heading of a review page says on three of the sites.
REVIEW_HEADINGS = {
    "webmd": "User Reviews & Ratings - ",
    "drugs": "User Reviews for ",
    "drugratingz": "drug reviews",
}

# Sites whose page title starts with the drug's name.
FIRST_WORDS_OF_TITLES = ("everydayhealth", "drugratingz")

# What a front page without reviews says.
NO_REVIEWS_YET = "Be the first to share your experience with this treatment."

# Search pages: what stands before and after the key.
SEARCH_URL = {
    "webmd": ("https://www.webmd.com/drugs/2/search?type=drugs&query=", ""),
    "drugs": ("https://www.drugs.com/search.php?searchterm=", ""),
    "everydayhealth": ("https://www.everydayhealth.com/drugs/", "/reviews"),
    "drugratingz": ("https://www.drugratingz.com/searchResults.jsp?thingname=", "&1=&2="),
}
