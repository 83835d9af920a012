"""Fixed values that results depend on: word lists and patterns, in Java regex syntax."""

# Stop words of matching, embeddings, grading and quizzes.
STOPWORDS = tuple(
    """
    a an the and or but if then than so as of at by for with
    about into onto from to in on over under between through during
    before after above below up down out off again further once here
    there when where why how what which who whom whose this that these
    those is are was were be been being have has had having do does
    did doing will would shall should can could may might must not no
    nor only own same such too very just also it its they them their
    we our you your he she his her i me my all any both each
    few more most other some because while however therefore thus hence
    although though since until whether either neither one two three many
    much well often usually called known example explain describe define
    mean means tell give list used using use like within without
    """.split()
)

# Stop words of the English search analysis.
SEARCH_STOPWORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())

# Words that make hollow blanks.
WEAK_BLANKS = tuple(
    """
    process processes important various different number general certain
    common particular specific significant figure table chapter section
    introduction conclusion summary overview note notes part parts
    point points result results type types form forms case cases
    thing things term terms level levels amount order group groups
    area areas information material materials example examples study studies
    """.split()
)

# Endings of describing words.
DESCRIBING_SUFFIXES = tuple("al ar ic ive ous ful less able ible ed ing ly ate ize ise ify".split())

# Last words of half a thought.
DANGLING_ENDINGS = tuple("and or but with of the a an to for in on at by from that which as is are was were be if when than into".split())

# First words that point at something named before.
DANGLING_STARTERS = tuple("it its this that these those they them their he she his her him such both each".split())

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = tuple("e.g. i.e. etc. vs. cf. dr. mr. mrs. ms. prof. fig. eq. no. st. jr. sr. inc. ltd. approx. dept. univ. ch. sec. vol. pp. p.".split())

# Words that grading leaves out before it compares.
GRADING_FILLERS = tuple("the a an is are of to and".split())

# What opens and closes a sentence.
OPENS_SENTENCE = r"^[\p{Lu}\p{N}\"'“(\[]"
CLOSES_SENTENCE = r"[.!?][\")\]”']?$"

# Definition verbs.
DEFINITION_VERBS = ("is", "are", "refers to", "is defined as", "is called", "means", "consists of", "describes")

# Labels of front matter, before a colon or a dash.
FRONT_MATTER_LABELS = (
    "instructor", "professor", "lecturer", "teacher", "ta", "teaching assistant", "office hours?", "office", "email",
    "e-mail", "phone", "tel", "telephone", "course", "course code", "course title", "class", "room", "building",
    "campus", "semester", "term", "quarter", "year", "credits?", "units?", "prerequisites?", "pre-requisites?",
    "textbook", "required text", "readings?", "grading", "assessment", "evaluation", "attendance", "syllabus",
    "schedule", "contact", "website", "url", "department", "faculty", "university", "college", "school", "section",
    "lecture", "week", "unit", "module", "chapter", "page", "date", "time", "location", "venue", "due", "deadline",
    "objectives?", "outcomes?", "agenda", "outline",
)

# Contact details.
CONTACT = r"[\w.+-]+@[\w-]+\.[\w.]+|https?://\S+|www\.\S+|\+?\d[\d\s().-]{7,}\d"

# Phrases of administration, as whole words.
ADMINISTRATION = (
    "office hours?",
    "syllabus",
    "prerequisites?",
    "textbook",
    "required reading",
    "recommended reading",
    "grading (policy|scheme|criteria)",
    "will be graded",
    "final grade",
    "counts? towards? your grade",
    r"worth \d+ ?%",
    r"\d+ ?% of (the|your) (grade|mark)",
    "attendance (policy|is)",
    "academic integrity",
    "plagiarism",
    "late submissions?",
    "submit your",
    "hand in your",
    "due (date|on|by)",
    "is due",
    "exam (will be|is) held",
    "midterm (is|will)",
    "enrolment",
    "enrollment",
    "drop deadline",
    "course website",
    "teaching assistants?",
    "contact me",
    "email me",
    "reach me at",
    "my office",
    "all rights reserved",
    "copyright",
)

# Talk about the course, as whole words.
COURSE_TALK = (
    "(in |for |throughout )?(this|the following|the next|today's) (chapter|lecture|course|class|section|unit|module|slide|slides|presentation|deck|book|text|tutorial|lab|session|week|semester)",
    "(we|you|students?) (will|shall|are going to) (learn|study|cover|discuss|examine|explore|look at|review|see|be able to|understand|investigate)",
    "by the end of (this|the)",
    "(learning (objectives?|outcomes?|goals?)|course (overview|description|outline|objectives?)|table of contents|further reading|references|bibliography|acknowledge?ments?)",
    "welcome to",
)

# Course codes and personal asides.
COURSE_CODE = r"[A-Z]{2,4}\s?\d{3}"
PERSONAL_VERBS = "like|think|prefer|love|hate|guess|believe|find|would say"
