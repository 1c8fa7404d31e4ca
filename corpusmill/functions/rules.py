"""Rule tables that results depend on. All are fixed values."""

from __future__ import annotations

# Question patterns by category in the order of their tests.
COMPARISON = r"(?i)\b(compare|comparison|difference|differences|difference\s+between|versus|vs\.?|better\s+than|pros\s+and\s+cons|differ|distinguish|relative\s+to|in\s+contrast|contrast\s+between)\b"
ENUMERATION = r"(?i)\b(list|enumerate|give\s+me\s+all|what\s+are\s+all|all\s+eligible|all\s+available|all\s+paid|all\s+company|complete\s+list|breakdown\s+of\s+all|every\s+single)\b"
PROCEDURAL = r"(?i)\b(how\s+to|how\s+do\s+i|how\s+can\s+i|how\s+should\s+i|step\s+by\s+step|step-by-step|steps\s+to|steps\s+for|procedure\s+for|procedure\s+to|process\s+for|process\s+to|guide\s+to|instructions\s+for|workflow\s+for|how\s+does\s+one)\b"
GREETING = (
    r"(?i)^(hi|hello|hey|heya|hiya|greetings|howdy|good\s+(morning|afternoon|evening|day)|thanks|thank\s+you|who\s+are\s+you|what\s+can\s+you\s+do|how\s+are\s+you|how\s+can\s+you\s+help|help)"
    r"(\s+(there|everyone|all|assistant|bot|today|me))?[!?,. ]*(\s*(hi|hello|hey|how\s+are\s+you(\s+today)?|how\s+can\s+you\s+help(\s+me)?|who\s+are\s+you|what\s+can\s+you\s+do|how\s+can\s+you\s+assist(\s+me)?)[!?,. ]*)*$"
)
SMALLTALK = (
    r"(?i)^(hi|hello|hey|heya|hiya|wssup|what'?s\s*up|whats\s*up|sup|yo|good\s*(morning|afternoon|evening|day)|greetings|howdy|how\s*are\s*you|who\s*are\s*you|what\s*can\s*you\s*do|help|thanks|thank\s*you|bye|goodbye)"
    r"(\s+(there|everyone|all|assistant|bot|today|me|friend))?[!.? ]*$"
)
# Fixed values: (category, confidence, strategy, dense k, lexical k, fusion k, rerank n, score ratio, sub-queries, parents, temperature).
STRATEGIES = (
    ("comparison", 0.92, "comparison_broad", 25, 25, 60, 10, 0.30, True, True, 0.1),
    ("enumeration", 0.90, "enumeration_exhaustive", 30, 30, 60, 12, 0.25, True, False, 0.1),
    ("procedural", 0.90, "procedural_workflow", 15, 15, 60, 6, 0.35, False, True, 0.1),
    ("conversational", 0.95, "conversational_bypass", 0, 0, 0, 0, 0.0, False, False, 0.7),
    ("factual", 0.85, "factual_precision", 10, 10, 60, 4, 0.45, False, False, 0.1),
    ("empty", 0.50, "balanced_hybrid", 25, 25, 60, 6, 0.40, False, True, 0.1),
)
# Phrases that trigger further search terms, policy topics first.
POLICY_TERMS = (
    (("health benefit", "health insurance", "benefits", "eligible for health", "enrollment"), "health insurance medical dental vision eligibility enrollment waiting period 30 days"),
    (("resign", "resignation", "quit", "notice when", "two weeks", "give notice"), "employment at-will termination separation resignation notice period"),
    (("dress code", "attire", "grooming", "appearance"), "dress code appearance grooming professional attire"),
    (("confidential", "trade secret", "proprietary"), "confidential trade secret proprietary non-disclosure"),
    (("disciplinary", "discipline", "policy violation", "corrective action"), "disciplinary action corrective action termination violation investigation report supervisor"),
    (("second job", "outside consulting", "moonlight", "outside employment", "consulting while"), "outside employment moonlighting conflict of interest electronic communications ethics approval"),
)
GUIDE_TERMS = (
    (("building block", "building blocks", "six building"), "Role-playing Focus Tasks Tools Cooperation Guardrails Planning Memory six AI agents"),
    (("types of memory", "memory do agents", "memory types", "memory agents use"), "short-term long-term entity episodic semantic procedural memory"),
    (("design pattern", "design patterns", "agent pattern", "most popular"), "ReAct reflection planning tool use multi-agent orchestration design patterns"),
    (("sub-agent", "sub-agents", "subagent", "orchestration roles", "roles can"), "manager specialist research summarization delegation orchestration sub-agent"),
    (("currency", "convert_currency", "exchange rate", "real-world capability", "conversion tool"), "convert_currency real-time currency conversion exchange rate tool invocation"),
    (("custom tool", "build custom", "create tool", "tool for an agent"), "custom tools MCP function implementation agent tools building block"),
    (("code is available", "full code", "code examples", "where does the guidebook point"), "code is available Check this code dailydoseofds link repository"),
    (("check this out", "code walkthrough", "walkthrough"), "Check this out code walkthrough example snippet"),
    (("guardrails", "guardrail"), "Guardrails building block safety constraints limits validation checkpoints"),
    (("planning building block",), "Planning building block six building blocks 5 Levels subdividing tasks"),
    (("manager agent", "multi-agent setup"), "manager agent coordinates sub-agents multi-agent pattern"),
    (("rag", "agent workflow"), "Agentic RAG retriever agent workflow vector DB context"),
)
# Several patterns each joined by | into one, so that a question is read once.
LIST_PATTERNS = r"(?i)(\blist\b|\bbuilding\s+blocks?\b|\bpay\s+special\s+attention\b|\bfor\s+each\b|\ball\s+\d+\b|\btypes?\s+of\b|\bwhat\s+are\s+the\b|\bhow\s+many\b|\broles?\s+can\b|\bdesign\s+patterns?\b|\bmost\s+popular\b|\bguardrails?\b)"
PRONOUNS = r"\b(it|its|this|that|these|those|they|them|their|his|her|he|she|same|else|another)\b"
REFERENCES = r"\b(what\s+about|how\s+about|tell\s+me\s+more|explain\s+more|more\s+details|how\s+long|where\s+is|why\s+is|how\s+so|what\s+else|any\s+exceptions?|does\s+it|can\s+you\s+elaborate)\b"
POLICY_WORDS = ("vacation", "pto", "sick leave", "resignation", "at-will")
GUIDE_WORDS = ("building block", "agent", "sub-agent", "convert_currency", "mcp")
EDGE_WORDS = ("vacation", "pto", "sick leave", "sick day", "sick days", "nonprofit", "leave policy", "employee benefits", "health benefits")
CODE_PATTERNS = (
    r"(?i)(\bcurrency\b|\bconvert_currency\b|\breal-?world\b.+\btool\b|\bcustom\s+tool|\bcode\s+(is\s+)?available\b|\bcheck\s+this\s+out\b|\bcode\s+walkthrough|\bfull\s+code\s+examples?\b|\bcode\s+examples?\b|\bshow\b.+\btool\s+example|\bwhere\b.+\bpoint\b.+\bcode\b|\bconversion\s+tool\b)"
)
# Department aliases in order of their tests.
DEPARTMENTS = (
    ("HR", ("hr", "human resources", "people", "people operations", "people ops", "talent", "personnel", "employee relations")),
    ("IT", ("it", "information technology", "infosec", "cybersecurity", "cyber security", "information security", "tech ops", "systems administration", "systems admin")),
    ("Finance", ("finance", "accounting", "payroll", "tax", "treasury", "billing", "financial operations")),
    ("Legal", ("legal", "compliance", "regulatory", "governance", "contracts", "ethics", "legal affairs", "legal & compliance")),
    ("Operations", ("operations", "facilities", "logistics", "workplace", "real estate")),
    ("Engineering", ("engineering", "r&d", "software engineering", "product", "quality assurance", "qa")),
    ("Marketing", ("marketing", "communications")),
    ("Sales", ("sales", "business development")),
)
COMPANY_WIDE = ("general", "company-wide", "all employees", "corporate")
DEPARTMENT_LABELS = (
    r"(?i)\b(?:Department|Dept|Owner|Division|Functional Area)\s*[:=\-]\s*([A-Za-z0-9 &/\-_]+)",
    r"(?i)\b(?:Issued By|Authorizing Body|Administered By)\s*[:=\-]\s*([A-Za-z0-9 &/\-_]+)",
)
POLICY_ID_PATTERNS = (
    r"(?i)\b(?:Policy\s*(?:ID|Number|No\.?|#)|Doc(?:ument)?\s*(?:ID|Code|Ref|Reference|No\.?))\s*[:=\-]?\s*([A-Za-z0-9\.\-_/]+)",
    r"\b([A-Z]{2,6}[-_][A-Z]{2,6}[-_]\d{2,5}(?:[-_]v?\d+)?)\b",
    r"\b([A-Z]{2,5}[-_]\d{2,5}(?:[-_]v?\d+)?)\b",
    r"(?i)\bPolicy\s*(?:#|No\.?)\s*(\d+(?:\.\d+)+)\b",
)
DATE_LABELS = (
    r"(?i)\b(?:Effective\s+Date|Effective|Date\s+of\s+Issue|Date\s+of\s+Effectiveness)\s*[:=\-]?\s*([A-Za-z0-9, /.\-]+)",
    r"(?i)\b(?:Last\s+Revised|Revised\s+Date|Revised|Last\s+Updated|Published\s+Date)\s*[:=\-]?\s*([A-Za-z0-9, /.\-]+)",
    r"(?i)\b(?:Date\s*[:=\-])\s*([A-Za-z0-9, /.\-]+)",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ROLES = (
    "full-time employees", "part-time employees", "system administrators", "system administrator", "contractors", "contractor", "employees", "employee", "managers", "manager", "directors", "director",
    "supervisors", "supervisor", "executives", "executive", "sysadmin", "ciso", "cto", "cfo", "ceo", "general counsel", "hr director", "department head", "compliance officer", "ethics officer", "privacy officer",
)
DOLLARS = r"(?i)\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?(?:\s*(?:million|thousand|k|M|billion))?(?:\s*\/\s*(?:day|week|month|year|meal|trip|incident|yr))?"
DURATIONS = r"(?i)\b\d+\s*(?:business\s+|calendar\s+|working\s+)?(?:days?|weeks?|months?|years?|hours?)\b"
TITLES = r"(?i)\b(HR Director|Department Head|Chief [A-Za-z]+ Officer|CISO|CTO|CFO|CEO|Manager|Supervisor|Employee|Contractor|System Administrator|Admin|Ethics Officer|Compliance Officer|Privacy Officer|People Operations Manager|Managing Director|General Counsel)\b"
PERIODS = r"(?i)\b(probationary period|notice period|waiting period|retention period|grace period|annual review|quarterly review|bi-weekly|monthly|semi-annual|at-will employment)\b"
TOPIC_WORDS = (
    "security", "vpn", "access control", "password", "mfa", "encryption", "pto", "vacation", "sick leave", "leave", "parental leave", "benefits", "travel", "expenses", "reimbursement", "per diem", "mileage",
    "remote work", "work from home", "wfh", "hybrid work", "code of conduct", "ethics", "harassment", "confidentiality", "health insurance", "medical", "dental", "vision", "401k", "salary", "payroll", "overtime",
    "bonus", "performance review", "discipline", "termination", "workplace safety", "osha", "onboarding", "background check",
)
TOPICS = (
    ("remote_work", ("remote work", "work from home", "wfh", "telework", "telecommuting", "home office", "virtual work", "remote employee", "hybrid work", "flexible work")),
    ("leave_pto", ("pto", "paid time off", "vacation", "sick leave", "sick day", "bereavement", "parental leave", "maternity", "paternity", "fmla", "jury duty", "unpaid leave", "holiday pay", "leave of absence", "sabbatical")),
    ("it_security", ("password", "mfa", "2fa", "authentication", "encryption", "data security", "vpn", "access control", "phishing", "incident response", "endpoint", "byod", "acceptable use", "clean desk", "data retention", "cybersecurity", "confidentiality")),
    ("expenses_travel", ("travel expense", "per diem", "mileage", "reimbursement", "hotel", "airfare", "business meals", "receipts", "lodging", "expense report", "corporate card", "travel policy", "entertainment expense")),
    ("benefits_health", ("health insurance", "medical", "dental", "vision", "401k", "retirement", "hsa", "fsa", "life insurance", "disability", "wellness program", "cobra", "tuition assistance", "commuter benefits")),
    ("code_of_conduct", ("code of conduct", "ethics", "harassment", "sexual harassment", "discrimination", "whistleblower", "conflict of interest", "gifts and entertainment", "anti-bribery", "equal opportunity", "confidentiality", "nda", "workplace conduct")),
    ("compensation_payroll", ("salary", "base pay", "overtime", "bonus", "payroll", "direct deposit", "pay frequency", "wage", "timesheet", "exempt", "non-exempt", "minimum wage", "severance", "commission")),
    ("performance_discipline", ("performance review", "performance appraisal", "disciplinary action", "pip", "performance improvement", "written warning", "termination", "resignation", "at-will", "notice period", "separation", "exit interview")),
    ("safety_workplace", ("workplace safety", "osha", "ergonomics", "emergency evacuation", "fire safety", "first aid", "workplace injury", "hazard reporting", "security badge")),
    ("hiring_onboarding", ("onboarding", "background check", "probationary period", "job description", "recruitment", "interviewing", "referral bonus", "orientation")),
)
# Common words that carry no claim.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but",
    "by", "can't", "cannot", "could", "couldn't", "did", "didn't", "do", "does", "doesn't", "doing", "don't", "down", "during", "each", "few", "for", "from", "further", "had", "hadn't", "has",
    "hasn't", "have", "haven't", "having", "he", "he'd", "he'll", "he's", "her", "here", "here's", "hers", "herself", "him", "himself", "his", "how", "how's", "i", "i'd", "i'll", "i'm", "i've", "if",
    "in", "into", "is", "isn't", "it", "it's", "its", "itself", "let's", "me", "more", "most", "mustn't", "my", "myself", "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other", "ought",
    "our", "ours", "ourselves", "out", "over", "own", "same", "shan't", "she", "she'd", "she'll", "she's", "should", "shouldn't", "so", "some", "such", "than", "that", "that's", "the", "their",
    "theirs", "them", "themselves", "then", "there", "there's", "these", "they", "they'd", "they'll", "they're", "they've", "this", "those", "through", "to", "too", "under", "until", "up", "very",
    "was", "wasn't", "we", "we'd", "we'll", "we're", "we've", "were", "weren't", "what", "what's", "when", "when's", "where", "where's", "which", "while", "who", "who's", "whom", "why", "why's",
    "with", "won't", "would", "wouldn't", "you", "you'd", "you'll", "you're", "you've", "your", "yours", "yourself", "yourselves", "per", "give", "tell", "please", "explain", "according", "document",
    "documents", "section", "sections", "stated", "states", "state", "refer", "refers", "referred", "recognized", "recognizes", "considered", "consider", "derived", "derives", "based", "provided",
    "provides", "mentioned", "mentions", "text", "indicate", "indicates", "indicating", "yes", "one", "two", "also", "including", "includes",
)
NUMBERS = r"(?i)(\$\s*[\d,]+(?:\.\d+)?|\b\d+(?:\.\d+)?\s*%|\b\d+\s*(?:days?|months?|years?|hours?|weeks?|minutes?|dollars?)\b|\b\d{2,}(?:,\d{3})*(?:\.\d+)?\b)"
ABSTENTION = "unable to answer"

# Topics of questions by family, in the order of their tests: what a question must hold (all words of one of the alternatives), what marks chunks that define the
# topic, mention it, and mislead, and the search that finds its chunks. The family tool asks for a code question first; its last kind is any other one.
TOPIC_FAMILIES = {
    "tool": (
        ("currency", (("currency",), ("convert_currency",), ("conversion tool",), ("currencyconverter",), ("exchange rate",)), ("currencyconverter", "currency conversion", "convert_currency", "exchange rate", "currency_analyst", "real-time currency", "live exchange"), (), (), ""),
        ("code_links", (("code is available",), ("full code",), ("point", "code")), ("code is available", "check this code", "dailydoseofds.com/p/"), (), (), ""),
        ("walkthrough", (("check this out",), ("walkthrough",)), ("check this out",), (), (), ""),
        ("generic", (("",),), ("custom tools via mcp", "build custom tools", "custom tools at times", "@mcp.tool", "mcp.tool()"), (), (), ""),
    ),
    "guidebook": (
        ("planning_block", (("planning", "building block"),), ("subdividing tasks", "outlining objectives"), ("planning building block", "building block", "five levels of agentic", "six building blocks", "subdividing tasks", "outlining objectives", "#4) planning pattern", "planning pattern"), ("plan-and-execute", "plan and execute", "design patterns", "react", "reflection pattern", "agentic ai design patterns"), "Planning building block subdividing tasks outlining objectives six building blocks"),
        ("guardrails", (("guardrail",),), ("5) guardrails", "4. guardrails", "examples of useful guardrails", "without constraints", "limiting tool usage", "validation checkpoints", "agents are powerful but without constraints"), ("guardrail", "examples of useful guardrails", "validation checkpoints", "limiting tool usage"), (), "Guardrails building block safety constraints limits validation checkpoints"),
    ),
    "agent": (
        ("manager_agent", (("manager agent",), ("multi-agent", "what does", "do")), ("manager agent", "coordinates multiple sub-agents"), ("multi-agent pattern",), ("multi-agent hotel finder", "multi-agent content creation", "multi-agent deep researcher", "kickoff and results"), "manager agent coordinates sub-agents multi-agent pattern iteratively"),
        ("rag_in_agent", (("rag", "agent"),), ("agentic rag", "retriever agent", "vector db", "dynamically fetch context", "retrieves the relevant context"), (), (), "Agentic RAG retriever agent workflow vector DB Firecrawl context"),
        ("memory_block", (("memory", "building block"), ("memory", "how does memory")), ("short-term memory", "long-term memory", "entity memory"), ("without memory", "building blocks of ai agents"), (), "Memory building block short-term long-term entity memory agents improve"),
    ),
    "policy": (
        ("dress_code", (("dress code",), ("dress policy",), ("attire",), ("grooming",), ("appearance",), ("what to wear",)), ("dress and grooming standards", "clean, neat, and professional appearance", "dress according to the requirements of their positions"), ("professional appearance", "dress and grooming", "medical or religious accommodation"), (), "Dress and Grooming Standards professional appearance clean neat attire grooming"),
    ),
}

# Pattern of a question in small letters, the sub-questions that it adds, in the order of their tests.
SUB_QUESTIONS = (
    (r"guardrails?", ("Guardrails building block AI agents safety constraints", "Examples of useful guardrails agents")),
    (
        r"building\s+blocks?",
        (
            "5 Levels of Agentic AI Systems building blocks overview", "six building blocks Role-playing Tools Memory Guardrails Planning", "Role-playing building block AI agents", "Tools MCP building block AI agents",
            "Memory building block AI agents", "Guardrails building block AI agents", "Planning building block AI agents", "Cooperation Focus Tasks building block AI agents",
        ),
    ),
    (r"planning\s+building\s+block", ("Planning building block AI agents 5 levels",)),
    (r"(?s)(?=.*how\s+many)(?=.*building)", ("six building blocks overview AI agents",)),
    (r"types?\s+of\s+memory|memory\s+do\s+agents|memory\s+types?", ("short-term memory agents", "long-term memory agents", "entity memory agents", "episodic semantic procedural memory agents")),
    (r"design\s+patterns?|agent\s+patterns?|popular", ("ReAct agent design pattern", "reflection agent pattern", "planning pattern agents", "tool use agent pattern", "multi-agent orchestration design patterns")),
    (r"(?s)(?=.*(?:sub-?agents?|orchestration))(?=.*roles?)", ("research agent orchestration", "manager agent sub-agent specialization", "sub-agent roles delegation")),
    (r"currency|convert_currency|exchange\s+rate|conversion\s+tool", ("convert_currency real-time currency conversion tool", "currency conversion tool example invocation exchange rate", "real-world capability currency tool demonstrate")),
    (r"code\s+(is\s+)?available|full\s+code|code\s+example", ("code is available full code examples guidebook link", "Check this code dailydoseofds link repository")),
    (r"check\s+this\s+out|code\s+walkthrough", ("Check this out code walkthrough example snippet", "Check this out currency conversion tool", "Check this out custom tool MCP")),
    (r"custom\s+tool|build\s+custom", ("custom tools MCP function implementation",)),
    (r"manager\s+agent", ("manager agent coordinates sub-agents multi-agent pattern",)),
)
