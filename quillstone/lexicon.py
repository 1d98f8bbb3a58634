"""Word lists. They are data: every operator takes them as arguments, these are the defaults.

Fixed values, so that questions are read in the same way: stop words, expansions, typos,
tags and intents. Names of one organisation and its people are left out; add your own.
"""

from __future__ import annotations

QUERY_STOP = "kya hai kon kaun ki ka ke se ko ne ye yeh what who is the a an of in for and how where when which does was are kia hain mein par say hota hoti hote karta karte karo bata batao wala wali".split()
SUBJECT_STOP = "what which where when does that this with from about have been will shall their these salary scale detail full explain the for and how are is can may should".split()
OVERLAP_STOP = "the a an is are was were to of and or in on at for from by with about tell me who what when where why how please".split()
KEEP_SHORT = "ai ml it hr ipo cto tor tors dg eo io sso".split()

#: Abbreviations and misspellings of 'schedule'. Fixed values; the pay package of one organisation is left out.
ABBREVIATIONS = {
    "cto": "Chief Technology Officer", "dg": "Director General", "mgr": "Manager", "hr": "Human Resources", "it": "Information Technology",
    "eo": "Enforcement Officer", "io": "Investigation Officer", "sso": "System Support Officer", "tor": "Terms of Reference",
    "jd": "Job Description", "sr": "Service Rules", "lms": "Learning Management System", "faqs": "Frequently Asked Questions",
    "schedudle": "schedule", "scheduel": "schedule", "scedule": "schedule", "sehdule": "schedule", "skedule": "schedule",
    "schdule": "schedule", "shcedule": "schedule", "shadule": "schedule", "schedul": "schedule",
}
ROMAN = {"1": "I", "2": "II", "3": "III", "4": "IV", "5": "V", "6": "VI", "7": "VII", "8": "VIII", "9": "IX", "10": "X"}
#: Common misspellings. Fixed values.
TYPOS = {
    "genral": "general", "genreal": "general", "gneral": "general",
    "directer": "director", "diretor": "director", "drector": "director",
    "suppor": "support", "suport": "support", "suppert": "support",
    "salarey": "salary", "salaray": "salary", "salery": "salary",
    "offcer": "officer", "oficer": "officer", "offier": "officer",
    "manger": "manager", "mangaer": "manager", "maneger": "manager",
    "enforcment": "enforcement", "enforcemnt": "enforcement",
    "moniter": "monitor", "monitering": "monitoring", "montioring": "monitoring",
    "additonal": "additional", "aditional": "additional",
    "asistant": "assistant", "assistent": "assistant",
    "benifit": "benefit", "benfit": "benefit", "benifits": "benefits",
    "allowence": "allowance", "alowance": "allowance",
    "compansation": "compensation", "compenstion": "compensation",
    "responsibilties": "responsibilities", "responsibiliy": "responsibility",
    "qualificaton": "qualification", "qualifcation": "qualification",
    "experiance": "experience", "experienc": "experience",
    "regulaton": "regulation", "regulaion": "regulation",
    "notificaton": "notification", "noification": "notification",
    "suppo": "support",
}
#: Words of a question that call for neighbouring pages. Fixed values.
EXPANSION_TRIGGERS = ["salary", "pay", "allowance", "benefit", "scale", "grade", "compensation", "detail", "full", "sab kuch", "batao", "explain", "structure", "salay", "tankhwah", "tankha", "kitni", "payscale", "pay scale", "maaash", "maash"]
#: Words of lines that may repeat on every page; names of organisations are yours to add.
HEADER_MARKS = ["government", "authority", "confidential", "all rights reserved"]
KEEP_MARKS = ["schedule", "annex", "appendix", "terms of reference", "chief technology officer"]
REFUSALS = ["not available in the provided context", "not found in the provided", "i couldn't find", "i could not find", "no information available", "not mentioned in the context", "available nahi hai", "information is not available"]

#: Pattern (from a word boundary to the next) -> tag, in order. Fixed values.
TAGS = [
    ("schedule", "schedule"), ("scheduled", "scheduled"), ("annex(ure)?", "annexure"), ("appendix", "appendix"), ("table", "table"),
    ("shall\\s+consist", "composition"), ("consist\\s+of", "composition"), ("composition", "composition"), ("constitution", "constitution"), ("member(s)?", "members"),
    ("chairperson", "chairperson"), ("vice\\s+chairperson", "vice chairperson"), ("secretary", "secretary"), ("director\\s+general", "director general"),
    ("complaint(s)?", "complaint"), ("public\\s+complaint(s)?", "public complaint"), ("hearing(s)?", "hearing"), ("hearing\\s+officer", "hearing officer"),
    ("grievance", "grievance"), ("appeal", "appeal"), ("procedure", "procedure"), ("process", "process"), ("how\\s+to", "how to"),
    ("purpose", "purpose"), ("objective(s)?", "objectives"), ("function(s)?", "functions"), ("mandate", "mandate"), ("established\\s+to", "established to"),
    ("vision", "vision"), ("mission", "mission"), ("recruitment", "recruitment"), ("eligibil[\\p{L}\\p{N}_]*", "eligibility"), ("qualification(s)?", "qualification"),
    ("experience", "experience"), ("contract(ual)?", "contract"), ("probation", "probation"), ("termination", "termination"),
    ("disciplin[\\p{L}\\p{N}_]*", "discipline"), ("misconduct", "misconduct"), ("faq", "faq"), ("frequently\\s+asked", "faq"), ("question(s)?", "questions"), ("answer(s)?", "answers"),
]
#: Intent, the words that show it, and the terms that it adds to a question. Fixed values, but for names of one organisation.
INTENTS = [
    ("composition", "composition|constitut|constitution|constitute|consist|comprise|members?|authority", "shall consist comprise constitution member chairperson vice secretary include following"),
    ("criteria", "criteria|criterion|eligib|qualification|qualify|required|requirement|experience|education|minimum|degree|age|skills?", "eligibility criteria qualification experience education minimum required requirement age degree"),
    ("complaint", "complaint|complain|grievance|petition|hearing|hearing officer|appeal", "complaint complaints hearing hearing officer file submit procedure process"),
    ("vision", "vision|mission|objective|objectives|purpose|aim|aims|mandate", "purpose objectives functions mandate aim established"),
    ("role", "role|roles|tor|tors|terms of reference|duty|duties|responsibil|function|job description", "terms reference duties responsibilities job description reports reporting manager"),
    ("schedule", "schedule|scheduled +laws|annex(ure)?|appendix", "schedule scheduled annex annexure appendix section"),
]
#: Phrases that answer questions of an intent. Fixed values, but for names of one organisation.
PHRASES = {
    "composition": ["authority shall consist of", "constitution of the authority", "members of the authority", "the authority shall consist", "shall consist of the following members"],
    "criteria": ["eligibility criteria", "minimum qualification", "qualification and experience", "required qualification", "experience required", "education", "age limit", "skills"],
    "complaint": ["file a complaint", "how can i file a complaint", "public complaint", "complaints and hearings", "hearing officer", "what happens after i file a complaint"],
    "vision": ["purpose of the authority", "objectives", "functions of the authority", "mandate", "established to", "for the purpose of"],
    "role": ["terms of reference", "job description", "duties and responsibilities", "responsibilities include", "shall be responsible for"],
}
GREETINGS = "hi|hello|hey|aoa|salam|assalam o alaikum|good morning|good evening"
#: (words of a question, marks of the chunks that it must see). Rules name one organisation's papers: add your own.
RULES: list[tuple[list[str], list[str]]] = []
#: Questions that want a name, and texts that have one. Fixed values.
NAME_WORDS = "(^|[^a-z])(name|nam|naam|kon|kaun|who)($|[^a-z])"
PERSON = "(Capt|Mr|Dr|Mrs|Ms|Col|Brig|Gen)\\.? +[A-Z][a-z]"

#: Greetings at the start of a turn, as patterns, and the replies to them. Fixed values.
GREETINGS_LATIN = "hi|hello|hey|hy|aoa|a\\.o\\.a|slm|salam|salaam|assalam|assalamu|asalam|good\\s+morning|good\\s+afternoon|good\\s+evening"
GREETINGS_URDU = "السلام\\s*علیکم|اسلام\\s*علیکم|سلام"
SALAM = "aoa|a\\.o\\.a|slm|salam|salaam|asalam"
ACK = "Hello! "
ACK_SALAM = "Wa Alaikum Assalam! "
ACK_URDU = "وعلیکم السلام! "
#: Turns that are a greeting as a whole. Fixed values.
GREETED = ["hi", "hello", "hey", "salam", "assalam o alaikum", "aoa", "greetings", "slam", "slm", "ssa"]
#: Questions about the assistant itself, anywhere and in short turns; words of roles, whose names are another matter. Fixed values.
IDENTITY = ["tera naam", "tumhara naam", "ap ka naam", "aap ka naam", "tum kon", "aap kon", "tera nam", "tumhara nam", "your name", "who are you"]
IDENTITY_SHORT = ["nam kia hai", "naam kya hai", "name kia hai", "nam kya hai"]
ROLE_WORDS = "cto dg director manager sdeo head officer chairman chairperson secretary deputy assistant monitoring legal finance admin hr procurement".split()
#: Questions about who made the assistant. Fixed values.
MAKERS = [
    "kisne banaya", "kis ne banaya", "kisnyu bnaya", "kisny bnaya", "who made", "who created", "who developed", "who built",
    "tumhe banaya", "tumhe bnaya", "aapko banaya", "aapko bnaya", "ye banaya", "yeh banaya", "is ko banaya",
    "developed by whom", "created by whom", "made by whom",
]
#: Names of the organisation that the collection is about, in lower case (a question about who made it is no question about the assistant): add your own.
OWN_NAMES: list[str] = []
BOT_WORDS = ["ai", "bot", "chatbot", "assistant"]
#: Marks of a refusal where one is due, and where none is. Fixed values, but for names of one organisation.
REFUSED = ["available nahi hai", "not available", "not found", "not contain", "nahi hai", "not specified", "unfortunately", "i could not find"]
REFUSED_PLAINLY = ["available nahi hai"]
#: Words of a question about pay or for details, which takes neighbouring pages along. Fixed values.
CONTEXT_WORDS = ["salary", "pay", "benefit", "scale", "allowance", "detail", "everything", "sab kuch", "all info", "full"]
#: Phrases of texts that answer questions about schedules. Fixed values.
SCHEDULE_PHRASES = ["scheduled laws", "schedule", "annex", "appendix", "annexure"]
#: Words that belong to an intent and so name nothing: what is left of a question's keywords are its entities.
INTENT_WORDS = sorted({w for _, pattern, extra in INTENTS for w in extra.split()} | {"role", "criteria", "complain"})
#: How papers put what a question of an intent asks; {} stands for the question. Fixed values, but for names of one organisation.
INTENT_WORDINGS = {
    "complaint": ["public complaints and hearings hearing officer process"],
    "vision": ["objects and purposes for which the authority is established"],
    "composition": ["authority shall consist of the following members chairperson vice chairperson secretary member", "constitution of the authority members of the authority"],
    "criteria": ["{} eligibility criteria qualification experience", "{} minimum qualification experience required"],
    "role": ["terms of reference duties and responsibilities job description"],
}
#: Words of a question that are not marked on a page. Fixed values.
HIGHLIGHT_STOP = "a an the is are was were of in on at to for with by about as from mein ka ki ke ko ne aur hai hain kya kyun kab kahan kaise kon who what where when why how batao bataen".split()
#: Words for short forms where texts are compared by words, and misspellings of the organisation's own name (add your own). Fixed values.
SHORT_FORMS = {
    "cto": "chief technology officer", "tor": "terms of reference", "tors": "terms of reference", "dg": "director general", "hr": "human resource",
    "it": "information technology", "mgr": "manager", "dev": "development", "sr": "senior", "jr": "junior",
    "eo": "enforcement officer", "io": "investigation officer", "sso": "senior staff officer",
}
OWN_MISSPELLINGS: dict[str, str] = {}
