"""Phrase vocabularies for question and follow-up annotation.

These lists must equal the reference's so that the annotation agrees; they
are given in their natural order (order matters where the first match wins).
"""

# --- question parsing -------------------------------------------------------
FORECAST_QUALITY_PHRASES = (
    "forecast quality", "weakest forecast", "weak forecast", "at-risk forecast", "at risk forecast",
    "poor forecast", "weak pipeline", "highest at-risk", "highest at risk", "most at-risk", "most at risk",
    "weakest category",
)
LEAD_CONVERSION_PHRASES = (
    "low conversion", "poor conversion", "highest estimated value but low conversion",
    "high lead value but poor conversion", "expensive but weak opportunities", "weak opportunities",
)
TIME_TREND_PHRASES = (
    "monthly pipeline trend", "pipeline by month", "revenue trend by closing date", "monthly deal amount trend",
    "revenue trend by month", "trend based on closing date",
)
CHART_KEYWORDS = ("chart", "graph", "plot", "visualize", "visualise")
METRIC_KEYWORDS = {
    "revenue": ("revenue", "sales", "total revenue", "total sales", "amount", "deal value", "value"),
    "average_deal_size": ("average deal size", "avg deal size", "average value", "avg value"),
    "pipeline": ("pipeline", "pipeline value", "open pipeline"),
    "margin": ("margin", "expected margin"),
    "deal_count": ("count", "number of deals", "deal count"),
    "win_rate": ("win rate", "conversion rate"),
}
DIMENSION_HINTS = {
    "Customer_Type": ("customer type", "customer segment", "segment"),
    "Account_Name": ("account name", "customer name", "account", "customer"),
    "Product_Name": ("product name", "item name", "sku"),
}
LIMIT_PATTERNS = (r"\b(?:top|bottom)\s+(\d+)\b", r"\bgive me\s+(\d+)\b", r"\bshow\s+(\d+)\b",
                  r"\bfirst\s+(\d+)\b")
DESC_TOKENS = ("top", "best", "highest", "strongest", "most", "leading")
ASC_TOKENS = ("bottom", "worst", "lowest", "weakest", "underperforming", "least")
GROUPED_METRICS = ("revenue", "pipeline", "average_deal_size", "deal_count", "margin", "win_rate")
GROUPED_CHART_PREFIXES = ("show ", "revenue by", "pipeline by", "average deal size by", "deal count by",
                          "margin by", "win rate by")
CONTEXT_METRIC_TOKENS = ("compare", "show it", "show this", "filter", "rank", "priority", "recommend")
CONTEXT_DIMENSION_TOKENS = ("show it by", "compare this by", "now show", "rank", "filter", "show this as", "which")

# --- chart intent --------------------------------------------------------------
CHART_INTENT_KEYWORDS = ("chart", "graph", "plot", "visualize", "visualise")
CHART_BY_PATTERNS = ("revenue by ", "amount by ", "pipeline by ", "estimated value by ", "lead value by ",
                     "average deal size by ", "avg deal size by ", "count of deals by ", "count of leads by ",
                     "monthly pipeline by ")
CHART_VALUE_TOKENS = ("revenue", "amount", "pipeline", "value", "average", "count", "monthly")

# --- qualitative routing ---------------------------------------------------------
QUALITATIVE_PHRASES = (
    "what does forecast quality mean", "explain forecast quality", "what does at-risk pipeline mean",
    "how should management interpret at-risk deals", "how should management interpret at-risk pipeline",
    "what should management focus on this week", "explain the sales pipeline health",
    "what does the dashboard tell us", "summarize the current pipeline", "summarise the current pipeline",
    "summarize this month's sales pipeline", "summarise this month's sales pipeline",
    "explain the forecast categories", "what does commit mean", "what does best case mean",
    "what does pipeline mean", "what does omitted mean", "what does po received mean", "what does closed won mean",
    "what does closed lost mean", "why is pipeline high but closed revenue low", "what risks should management review",
    "what should the sales team prioritize", "what are the main revenue risks",
    "how should i interpret the auto insights", "what does lead conversion mean", "what does win rate mean",
    "how should we use this report", "how should we use this dashboard",
)
QUANTITATIVE_BLOCKERS = (
    "what is the total pipeline value", "show revenue by region", "create a chart of deals by stage",
    "which product category has weakest forecast quality", "which product category has the weakest forecast quality",
    "show monthly pipeline trend by closing date", "show monthly pipeline trend based on closing date",
    "which lead source has high value but low conversion",
    "which lead source generates the highest estimated value but low conversion into deals",
    "what is the win rate", "what is the average deal size", "which sales rep has strongest pipeline",
    "how many leads", "how many deals",
)
QUALITATIVE_TOKENS = ("explain", "interpret", "summarize", "summarise", "what does", "how should", "why is")
QUALITATIVE_EXCLUDES = ("total", "chart", "graph", "plot", "revenue by", "amount by", "average deal size",
                        "win rate")

# --- follow-up intents ---------------------------------------------------------
ANALYTICS_VERBS = ("calculate", "compare", "rank", "show", "create", "plot", "filter", "group", "break down",
                   "list", "sort")
ANALYTICS_METRICS = ("total", "sum", "count", "average", "avg", "top", "bottom", "highest", "lowest", "best",
                     "worst", "trend", "monthly", "yearly", "conversion", "win rate", "forecast quality",
                     "sales rep", "salesman", "salesperson", "region", "product category", "pipeline", "deals",
                     "amount", "margin")
NEW_CHART_PHRASES = ("show this as a chart", "show this in a chart", "plot this as", "plot this", "create a chart",
                     "create chart", "make a chart", "build a chart", "graph this")
EXPLANATION_PHRASES = ("what does this chart tell us", "what does this chart actually tell us",
                       "what does this mean", "explain this", "interpret this", "why does this matter",
                       "is this good or bad", "what is driving this")
EXPLANATION_KEYWORDS = ("why", "explain", "meaning", "interpret", "tell us", "good or bad", "summary")
CHART_IMPROVEMENT_PHRASES = ("what changes can i make on this chart", "what are some changes i can make on this chart",
                             "how can this chart be improved", "how should i present this chart",
                             "make this visual better", "improve this chart", "improve this visual")
BUSINESS_RECOMMENDATION_PHRASES = ("what should management do", "what should sales focus on", "what are the risks",
                                   "what opportunities do we have", "what should we do next",
                                   "what should management focus on")
BUSINESS_RECOMMENDATION_KEYWORDS = ("management", "sales focus", "focus on", "risks", "risk", "opportunities",
                                    "next steps", "recommend", "action", "address", "reduce", "improve",
                                    "prioritize")
CLARIFICATION_PHRASES = ("what is forecast quality", "what does commit mean", "what does po received mean",
                         "what does pipeline mean", "what does omitted mean")
CLARIFICATION_PREFIXES = ("what is ", "what does ", "define ", "meaning of ")
UNRELATED_PHRASES = ("tell me a joke", "who won the world cup", "write python code", "write code")
CHART_NOUNS = ("chart", "graph", "visual")
CONTEXTUAL_ACTION_MARKERS = ("how should", "how can", "what should", "what can", "next", "address", "reduce",
                             "improve", "focus", "action")
QUALITATIVE_ACTION_PATTERNS = (
    r"\bhow\s+(?:can|should|do)\b",
    r"\bwhat\s+(?:can|should)\b.*\b(?:do|take|address|reduce|improve|focus)\b",
    r"\bwhat\s+.*\b(?:steps?|actions?|recommendations?)\b",
    r"\b(?:steps?|actions?)\s+(?:to|for)\b",
    r"\bwhy\s+(?:might|is|are|does|do)\b",
    r"\bwhat\s+does\s+(?:this|that|the)\b.*\bmean\b",
)
ACTION_MARKERS = ("management", "next steps", "suitable steps", "recommend", "interpret", "meaning", "explain")
ANALYTICS_OVERRIDE_TOKENS = ("compare", "rank", "bottom", "top", "worst", "weakest", "underperforming", "give me",
                             "show it by", "show this by", "filter to", "which sales reps", "which customer segment",
                             "product categories")
ANALYTICS_SHORT_TOKENS = ("total ", "sum ", "count ", "average ", "avg ", "total amount")
RANKING_FOLLOWUP_PATTERN = (r"\bwhich\s+(?:sales\s+rep|customer\s+segment|region|source|product\s+category)"
                            r"\b.*\b(?:highest|lowest|best|worst|priority)\b")
DOMAIN_TERMS = ("stage", "stages", "region", "source", "lead", "leads", "deal", "deals", "sales", "rep",
                "forecast", "product", "category", "pipeline", "revenue", "amount", "margin", "conversion", "win",
                "lost", "won", "risk")
TOKEN_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "by", "can", "do", "does", "for", "from", "how", "i",
                    "in", "is", "it", "me", "of", "on", "or", "should", "that", "the", "this", "to", "us", "we",
                    "what", "why", "with")
DEICTIC_TOKENS = ("this", "these", "it", "here", "there")
DEICTIC_PATTERN = r"\bthat\s+(?:result|chart|stage|source|region|category)\b"
RELEVANCE_ACTION_MARKERS = ("management", "focus", "next", "address", "reduce", "improve", "action")
FOLLOWUP_SUGGESTIONS = {
    "stage": ("Compare this stage by region", "Show only Closed Lost deals", "Why might this stage be weak?"),
    "source": ("Compare this source by sales rep", "What does this mean for lead quality?",
               "What should management focus on next?"),
    "region": ("Compare this by sales rep", "Show the trend by month", "What should management do here?"),
    "forecast": ("Break this down by sales rep", "Show the trend by month", "How should we address this?"),
    "default": ("What does this mean?", "Compare this by region", "What should management focus on next?"),
}
