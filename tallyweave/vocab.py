"""Word lists, lookup tables, patterns and formats that results depend on."""

# Coverage lookup: keywords, covered, coverage %, approval %, referral needed, annual limit, category, notes.
COVERAGE_LOOKUP = [
    dict(keywords=["screening", "preventive", "checkup", "annual exam"], covered=True, coverage=100, approval=98,
         referral=None, annual_limit=None, category="preventive",
         notes="Preventive care fully covered under ACA guidelines"),
    dict(keywords=["blood test", "lab work", "imaging", "x-ray", "mri", "scan"], covered=True, coverage=80,
         approval=85, referral=None, annual_limit=None, category="diagnostic",
         notes="Most diagnostic tests covered with pre-authorization"),
    dict(keywords=["diabetes", "blood sugar", "glucose", "a1c"], covered=True, coverage=80, approval=90,
         referral=None, annual_limit=None, category="treatment",
         notes="Chronic condition management covered under preventive care"),
    dict(keywords=["specialist", "consultation", "referral"], covered=True, coverage=70, approval=75,
         referral=True, annual_limit=None, category="specialist",
         notes="Specialist visits covered with referral"),
    dict(keywords=["medication", "prescription", "drug", "medicine"], covered=True, coverage=60, approval=82,
         referral=None, annual_limit=None, category="treatment",
         notes="Prescription coverage through pharmacy benefit"),
    dict(keywords=["therapy", "counseling", "rehabilitation", "physical therapy"], covered=True, coverage=65,
         approval=88, referral=None, annual_limit=20, category="therapy",
         notes="Therapy services covered with annual visit limits"),
    dict(keywords=["emergency", "urgent", "immediate care"], covered=True, coverage=85, approval=95,
         referral=None, annual_limit=None, category="treatment",
         notes="Emergency services covered at higher rate"),
]
NO_COVERAGE_NOTE = "No coverage information found for the specified treatment or condition"
REFERRAL_SUFFIX = " (Requires referral)"
PREAUTH_CATEGORY = "diagnostic"

# Specialist roles in their fixed order; the first is the primary one.
ROLES = [
    "Primary Care Physician",
    "Exercise Specialist",
    "Lifestyle and Wellness Coach",
    "Endocrinologist & Diabetes Expert",
    "Diabetes Nutrition Specialist",
]

# Routing keywords by category with their weight.
ROUTING_KEYWORDS = {
    "exercise": (3, ["fitness", "workout", "training", "gym", "cardio", "strength", "exercise"]),
    "nutrition": (3, ["diet", "food", "eating", "meal", "nutrients", "nutrition"]),
    "lifestyle": (2, ["habits", "sleep", "stress", "routine", "daily", "balance", "wellness"]),
    "medical": (5, ["pain", "symptoms", "condition", "disease", "treatment", "headache", "dizzy", "medication",
                    "doctor", "health", "medical", "diagnosis", "fever", "chronic"]),
}
PRIMARY_BOOST, PRIMARY_CATEGORY, ROLE_BOOST = 10, "medical", 5

# Priority words and order.
HIGH_PRIORITY_WORDS = ["immediate", "urgent", "emergency", "critical", "severe"]
LOW_PRIORITY_WORDS = ["maintain", "continue", "regular", "routine"]
CRITICAL_WORDS = ["ketoacidosis", "hypoglycemia", "hyperglycemia", "emergency", "immediate attention", "severe"]
PRIORITY_ORDER = {"high": 3, "medium": 2, "low": 1}
COMPLEXITY_PRIORITY = {"high": "high", "moderate": "medium", "low": "low"}
COMPLEXITY_ROLES = {"low": 1, "moderate": 2}

# Food terms and note texts.
LOW_IMPACT_TERMS = ["beans", "lentils", "nuts", "whole grains", "vegetables"]
HIGH_IMPACT_TERMS = ["white bread", "rice", "potato", "sugar", "candy"]
LOW_IMPACT_NOTE = "- %s: Low glycemic impact - generally good choice that helps maintain stable blood sugar"
HIGH_IMPACT_NOTE = (
    "- %s: High glycemic impact - may cause rapid blood sugar rise, consider portions carefully"
)

# Labelled answer fields: pattern and default; None means the whole text.
FIELD_PATTERNS = {
    "complexity": (r"(?i)Complexity:\s*(low|moderate|high)", "low"),
    "reasoning": (r"Reasoning:\s*([^\n]+)", ""),
    "message": (r"Message:\s*([^\n]+)", None),
    "team_conclusion": (r"Team Conclusion:\s*([^\n]+)", None),
}

# Context lines: field and format, then the role hint.
CONTEXT_LINES = [
    ("age", "Age: %s"),
    ("diabetes_type", "Diabetes Type: %s"),
    ("last_blood_sugar", "Last Blood Sugar Reading: %s mg/dL"),
    ("medications", "Current Medications: %s"),
]
CONTEXT_TITLE = "Patient Context:"
ROLE_HINT = "Please provide advice from your perspective as a %s."

# Call outcomes by call type, and those that count as success.
OUTCOMES = {
    "sales": ["SaleConfirmed", "LeadPending", "NoSale"],
    "support": ["Resolved", "NeedsFollowUp", "Unresolved"],
}
SUCCESS_OUTCOMES = ["SaleConfirmed", "Resolved"]
CALL_STATUSES = ["ringing", "in-progress", "completed", "failed"]
CALL_EVENT_TYPES = ["callStarted", "transcriptUpdate", "callEnded", "statusUpdate", "feedbackSubmitted"]
TASK_STATES = ["thinking", "executing_skill", "completed", "error"]

# Ledger enumerations and formats.
ACCOUNT_TYPES = ["asset", "liability", "equity", "revenue", "expense"]
STRICT_ACCOUNT_TYPES = ["checking", "savings", "credit", "cash"]
TRANSACTION_TYPES = ["debit", "credit"]
STRICT_TRANSACTION_TYPES = ["income", "expense", "transfer"]
DEFAULT_CATEGORY, DEFAULT_STATUS = "Uncategorized", "pending"
COMMAND_INTENTS = ["create_transaction", "get_transactions", "generate_report", "get_account_balance",
                   "categorize_transaction"]
COMMAND_ERROR_CODE = "COMMAND_PROCESSING_ERROR"

# Supported sets.
CURRENCIES = {"USD": "$", "EUR": "€", "GBP": "£", "CAD": "CA$", "AUD": "A$", "JPY": "¥"}
NO_FRACTION_CURRENCIES = ["JPY"]
LANGUAGES = ["en", "es", "fr", "de", "it", "ja"]
TIMEZONES = ["UTC", "America/New_York", "Europe/London", "Asia/Tokyo"]
CHAT_LANGUAGES = ["en", "es", "fr", "de", "it", "pt", "ru", "zh", "ja", "ko"]
CHAT_TIMEZONES = ["UTC", "America/New_York", "America/Los_Angeles", "Europe/London", "Europe/Paris", "Asia/Tokyo",
                  "Asia/Shanghai", "Australia/Sydney"]
DEFAULT_PREFERENCES = {"timezone": "UTC", "language": "en"}

# Patterns.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"
CURRENCY_CODE = r"^[A-Z]{3}\z"
SHORTEST_PASSWORD = 8
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$"
TOOL_CALL = r"(?s)\[SKILL_START\](.*?)\[SKILL_END\]"

# HTML entities, decoded in this order.
HTML_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'")]

# Markup rewrites, applied in this order.
MARKUP_REWRITES = [
    (r"\*\*(.*?)\*\*", "<strong>$1</strong>"),
    (r"\*(.*?)\*", "<em>$1</em>"),
    (r"\n\n", "</p><p>"),
]
INLINE_MATH = (r"\$(.*?)\$", '<span class="math">$1</span>')
DISPLAY_MATH = (r"\$\$(.*?)\$\$", '<div class="math">$1</div>')
CODE_BLOCK = (r"(?s)```(.*?)```", "<pre><code>$1</code></pre>")
MARKUP_WRAPPER = '<div class="tutor-response"><p>%s</p></div>'

# Text budget.
SHORTEST_CUT = 140
CHARS_PER_TOKEN = 3

# Date formats: tokens with their Spark form, longest first, and the four named styles.
DATE_TOKENS = [("YYYY", "yyyy"), ("MMMM", "MMMM"), ("MMM", "MMM"), ("MM", "MM"), ("DD", "dd"), ("dddd", "EEEE"),
               ("ddd", "EEE"), ("HH", "HH"), ("mm", "mm"), ("ss", "ss")]
DATE_STYLES = {"short": "M/d/yy", "medium": "MMM d, yyyy", "long": "MMMM d, yyyy", "full": "EEEE, MMMM d, yyyy"}

# Disclaimers by role.
DISCLAIMERS = {
    "Primary Care Physician": (
        "This advice is for informational purposes only and does not constitute medical diagnosis or treatment. "
        "Always consult with a qualified healthcare provider for medical advice."),
    "Exercise Specialist": (
        "Always consult with your healthcare provider before starting a new exercise program. "
        "Start slowly and progress gradually to avoid injury."),
    "Lifestyle and Wellness Coach": (
        "These are general lifestyle recommendations. For medical concerns, please consult with a healthcare provider."),
    "Endocrinologist & Diabetes Expert": (
        "This advice is for informational purposes only. Always consult with your healthcare provider before making "
        "changes to your diabetes management plan, especially regarding medication or insulin adjustments."),
    "Diabetes Nutrition Specialist": (
        "Individual responses to foods may vary. Monitor your blood sugar to understand how different foods affect "
        "you personally. Consider working with a registered dietitian for personalized meal planning."),
}
