"""Rule tables of the text analytics and the cleaner.

Every table is data: the operators take it as an argument, so a deployment can
pass its own.  The defaults below are fixed values that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Category:
    """One category: its keywords (duplicates count twice) and its weight."""

    name: str
    weight: float
    keywords: tuple[str, ...]


# --- fixed values: category keywords and weights, in priority order ----------
CATEGORY_RULES: tuple[Category, ...] = (
    Category("AI/ML", 2.0, (
        "ai", "artificial intelligence", "machine learning", "deep learning",
        "neural network", "llm", "gpt", "chatgpt", "claude", "gemini",
        "transformer", "nlp", "natural language", "computer vision",
        "generative ai", "gen ai", "diffusion", "stable diffusion",
        "midjourney", "dall-e", "openai", "anthropic", "hugging face",
        "tensorflow", "pytorch", "model", "training", "inference",
    )),
    Category("Funding", 1.5, (
        "funding", "raised", "series a", "series b", "series c", "seed",
        "investment", "investor", "vc", "venture capital", "valuation",
        "unicorn", "ipo", "acquisition", "acquired", "merger", "deal",
        "million", "billion", "$m", "$b", "round", "led by",
    )),
    Category("Product Launch", 1.5, (
        "launch", "launched", "announces", "introducing", "introducing",
        "new product", "release", "releases", "unveiled", "unveils",
        "available now", "now available", "rolling out", "beta",
        "general availability", "ga", "product hunt",
    )),
    Category("Security", 1.5, (
        "security", "vulnerability", "hack", "hacked", "breach",
        "ransomware", "malware", "cyber", "cybersecurity", "privacy",
        "encryption", "zero-day", "exploit", "patch", "cve",
        "authentication", "password", "phishing", "ddos",
    )),
    Category("Open Source", 1.3, (
        "open source", "open-source", "github", "gitlab", "repository",
        "repo", "fork", "star", "contributor", "maintainer", "license",
        "apache", "mit license", "gpl", "linux", "kubernetes", "docker",
    )),
    Category("Development", 1.0, (
        "developer", "programming", "code", "coding", "software",
        "api", "sdk", "framework", "library", "tool", "devops",
        "ci/cd", "testing", "debug", "ide", "vscode", "javascript",
        "python", "rust", "golang", "typescript", "react", "vue",
    )),
    Category("Enterprise", 1.0, (
        "enterprise", "saas", "b2b", "corporate", "business",
        "platform", "solution", "service", "cloud", "aws", "azure",
        "gcp", "salesforce", "microsoft", "google cloud", "oracle",
    )),
    Category("Gaming", 1.2, (
        "game", "gaming", "gamer", "xbox", "playstation", "nintendo",
        "steam", "epic games", "unity", "unreal", "esports", "vr",
        "virtual reality", "ar", "augmented reality", "metaverse",
    )),
)

# --- fixed values: words that never become keywords --------------------------
STOP_WORDS: tuple[str, ...] = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "can", "this", "that",
    "these", "those", "it", "its", "they", "them", "their", "we", "our",
    "you", "your", "he", "she", "his", "her", "what", "which", "who",
    "how", "why", "when", "where", "all", "any", "both", "each", "more",
    "most", "other", "some", "such", "no", "not", "only", "same", "than",
    "too", "very", "just", "also", "now", "new", "first", "last", "one",
    "two", "three", "said", "says", "get", "got", "make", "made", "use",
    "using", "used", "here", "there", "about", "into", "over", "after",
)

# --- fixed values: terms whose count is doubled ------------------------------
TECH_TERMS: tuple[str, ...] = (
    "ai", "ml", "api", "sdk", "saas", "paas", "iaas", "b2b", "b2c",
    "iot", "5g", "ar", "vr", "xr", "nft", "web3", "defi", "dao",
    "kubernetes", "docker", "aws", "gcp", "azure", "react", "vue",
    "python", "javascript", "typescript", "rust", "golang", "java",
    "ios", "android", "linux", "windows", "macos",
)

# --- fixed values: company names looked for as substrings --------------------
COMPANIES: tuple[str, ...] = (
    "google", "microsoft", "apple", "amazon", "meta", "facebook",
    "openai", "anthropic", "nvidia", "tesla", "spacex", "twitter",
    "stripe", "shopify", "salesforce", "oracle", "ibm", "intel",
    "amd", "qualcomm", "uber", "lyft", "airbnb", "netflix",
)

# --- fixed values: sentiment lexicon -----------------------------------------
POSITIVE_WORDS: tuple[str, ...] = (
    "success", "successful", "win", "won", "growth", "growing",
    "profit", "profitable", "launch", "launched", "innovative",
    "breakthrough", "achievement", "milestone", "record", "best",
    "leading", "top", "first", "revolutionary", "amazing", "great",
    "excellent", "impressive", "significant", "major", "boost",
)
NEGATIVE_WORDS: tuple[str, ...] = (
    "fail", "failed", "failure", "loss", "losing", "decline",
    "declining", "crash", "crashed", "layoff", "layoffs", "cut",
    "cuts", "shutdown", "closing", "bankrupt", "bankruptcy",
    "hack", "hacked", "breach", "vulnerability", "scandal",
    "controversy", "problem", "issue", "concern", "risk", "threat",
)

# --- fixed values: raw category -> standard category, in matching order ------
CATEGORY_MAP: dict[str, str] = {
    "ai": "AI/ML",
    "artificial intelligence": "AI/ML",
    "machine learning": "AI/ML",
    "deep learning": "AI/ML",
    "llm": "AI/ML",
    "generative ai": "AI/ML",
    "ml": "AI/ML",
    "funding": "Funding",
    "startups": "Funding",
    "venture capital": "Funding",
    "acquisition": "Funding",
    "ipo": "Funding",
    "fundraising": "Funding",
    "product launch": "Product Launch",
    "product": "Product Launch",
    "launch": "Product Launch",
    "security": "Security",
    "cybersecurity": "Security",
    "privacy": "Security",
    "open source": "Open Source",
    "github": "Open Source",
    "repository": "Open Source",
    "web development": "Development",
    "frontend": "Development",
    "backend": "Development",
    "devops": "Development",
    "tech news": "Tech News",
    "general": "Tech News",
    "enterprise": "Enterprise",
    "gaming": "Gaming",
}

# --- fixed values: defaults for missing fields -------------------------------
DEFAULT_AUTHOR = "Unknown"
DEFAULT_CATEGORY = "Tech News"
INGEST_DEFAULTS: dict[str, str] = {
    "title": "Untitled",
    "author": "Unknown",
    "content": "",
    "summary": "",
    "category": "General",
}

# --- fixed values: title words that decide the category of a feed item -------
FEED_TITLE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("AI/ML", ("ai", "artificial intelligence", "machine learning", "llm", "gpt")),
    ("Security", ("security", "hack", "breach", "cyber")),
    ("Funding", ("funding", "raised", "acquisition", "ipo")),
    ("Gaming", ("game", "gaming", "xbox", "playstation")),
)

# --- fixed values: description words that decide the category of a repository
REPO_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("AI/ML", ("ai", "machine learning", "neural", "llm", "gpt")),
    ("Web Development", ("web", "frontend", "react", "vue", "angular")),
    ("Backend", ("api", "backend", "server", "database")),
    ("DevOps", ("devops", "kubernetes", "docker", "ci/cd")),
    ("Security", ("security", "privacy", "encrypt")),
)

# --- fixed values: registered sources ----------------------------------------
# (name, display name, url, description)
DEFAULT_SOURCES: tuple[tuple[str, str, str, str], ...] = (
    ("hackernews", "Hacker News", "https://news.ycombinator.com",
     "Tech community news and discussions"),
    ("techcrunch", "TechCrunch", "https://techcrunch.com",
     "Startup and technology news"),
    ("producthunt", "Product Hunt", "https://www.producthunt.com",
     "New product launches"),
    ("github_trending", "GitHub Trending", "https://github.com/trending",
     "Trending repositories on GitHub"),
    ("venturebeat", "VentureBeat", "https://venturebeat.com",
     "Enterprise tech and AI news"),
)

# --- fixed values: sizes ------------------------------------------------------
MAX_ARTICLES = 100        # rows kept by retention
PAGE_SIZE = 20            # feed page
MAX_PAGE_SIZE = 100
MAX_TRENDING = 50
TRENDING_POOL = 100       # newest rows considered for trending
SUMMARY_CHARS = 200       # summary length in list views
HAS_CONTENT_CHARS = 100   # longer content counts as content
HASH_ID_CHARS = 24        # hex digits of the url hash
MAX_TAGS = 10
FEED_SUMMARY_CHARS = 500  # summary length of feed items
SHORT_CONTENT_CHARS = 500  # feed content below this is fetched from the page


@dataclass(frozen=True)
class Lexicon:
    """Word lists for sentiment scoring."""

    positive: tuple[str, ...] = field(default=POSITIVE_WORDS)
    negative: tuple[str, ...] = field(default=NEGATIVE_WORDS)
