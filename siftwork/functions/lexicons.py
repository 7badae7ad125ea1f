"""Word lists and tables of the moderation rules."""

# Every list below is data that results depend on word for word. The rupee sign in "earn ₹" is written as
# such throughout, as texts have it, also where a list's source holds it in a broken encoding.

MARKETING_PHRASES = (
    "buy now", "limited offer", "discount", "sale today", "join now", "click link", "click here", "register now",
    "earn money", "free course", "paid course", "subscribe", "promo code", "investment opportunity", "telegram link",
    "whatsapp group", "dm for details", "100% guaranteed", "earn ₹", "crypto signal", "make money fast",
    "work from home", "passive income", "refer and earn", "affiliate link", "use my code", "double your money",
    "risk free", "no risk", "instant profit",
)

COURSE_PHRASES = (
    "buy my course", "join my paid class", "limited seats", "seats are limited", "registration open", "enroll now",
    "dm for course", "paid class", "online class registration", "join my batch", "my coaching", "batch starting",
    "course starting", "pay and join",
)

POLITICAL_CAMPAIGN_PHRASES = (
    "vote for", "support the party", "campaign for", "join the movement", "elect", "party promotion", "vote our",
    "join our party", "rally for", "political rally", "support our candidate", "cast your vote", "vote in favour",
    "support this leader",
)

POLITICAL_TOPIC_PHRASES = (
    "prime minister", "chief minister", "parliament", "election", "bjp", "congress", "aap", "political party",
    "candidate", "manifesto", "constituency", "lok sabha", "vidhan sabha", "vote bank", "political agenda",
)

ANIMAL_CRUELTY_PHRASES = (
    "animal killing", "animal torture", "animal abuse", "dead animal", "hunting violence", "animal attacked",
    "injured animal", "animal blood", "slaughter animal", "kill the animal", "beat the animal", "animal fight",
    "cockfight", "dog fight",
)

HUMAN_KILLING_PHRASES = (
    "murder", "execution", "dead body", "human killing", "killed by", "person stabbed", "person shot",
    "was tortured", "beheading", "lynching", "mob lynching", "honour killing", "contract killing", "shoot to kill",
    "kill him", "kill her", "death threat",
)

HERITAGE_KEYWORDS = (
    "ramayana", "mahabharata", "bhagavad gita", "gita", "vedas", "vedic", "upanishad", "purana", "krishna", "rama",
    "vishnu", "shiva", "durga", "hanuman", "ganesh", "ganesha", "saraswati", "lakshmi", "parvati", "temple",
    "mandir", "puja", "darshan", "prasad", "aarti", "bhajan", "hinduism", "buddha", "buddhism", "jain", "jainism",
    "sikhism", "sufi", "bhakti", "devotion", "scripture", "mythology", "mahakavya", "indus valley", "harappan",
    "mughal", "maurya", "gupta", "maratha", "ayurveda", "yoga", "meditation", "sanskrit", "ashram", "sadhu",
    "diwali", "holi", "navratri", "dussehra", "janmashtami", "pongal", "eid", "ramzan", "christmas", "guru nanak",
    "sikh", "gurudwara",
)

ADVERTISING_PHRASES = (
    "sponsored", "sponsored ad", "advertisement", "paid partnership", "brand promotion", "brand deal",
    "product promotion", "buy now", "order now", "shop now", "get now", "limited time offer", "limited time only",
    "offer ends", "last day", "today only", "promo code", "coupon code", "use code", "discount", "sale",
    "sale today", "hurry up", "act now", "don't miss", "last chance", "free course", "free class", "free training",
    "free workshop", "free webinar", "free masterclass", "free session", "free batch", "paid course", "paid class",
    "paid training", "paid batch", "course selling", "online course", "join my course", "join my class",
    "join my batch", "buy my course", "enroll now", "enroll today", "register now", "registration open",
    "seats are limited", "limited seats", "batch starting", "batch starts", "next batch", "new batch",
    "morning batch", "evening batch", "weekend batch", "certification course", "get certified", "get certificate",
    "online training", "live class", "live session", "masterclass", "100% free", "totally free", "absolutely free",
    "click here", "click link", "link in bio", "check link", "visit link", "book your seat", "book your slot",
    "book now", "earn money", "make money", "earn from home", "work from home", "passive income", "earn ₹",
    "earn rs", "investment opportunity", "double your money", "risk free", "no risk", "instant profit",
    "100% guaranteed", "make money fast", "refer and earn", "recruitment campaign", "we are hiring", "apply now",
    "job opening", "hiring now", "vacancy", "walk in interview", "join now", "sign up now", "sign up free",
    "register free", "join telegram", "join whatsapp", "join our group", "join our channel", "influencer promotion",
    "muft course", "muft class", "muft training", "muft batch", "abhi join karo", "abhi register karo",
    "link dekhiye", "link pe click karo", "course join karo", "batch join karo", "paise kamao", "ghar baithe kamao",
    "ghar se kamao", "free mein sikhein", "bilkul free", "muft mein", "abhi enroll karo", "seats siimit hain",
    "jaldi karo", "aaj hi join karo", "aaj hi register karo",
)

AFFILIATE_PHRASES = (
    "affiliate", "affiliate link", "affiliate marketing", "referral", "referral code", "referral link",
    "use my code", "use code", "commission", "partner link", "crypto signal", "trading signal", "binary trading",
)

SOCIAL_MEDIA_PHRASES = (
    "follow us", "follow me", "follow for more", "follow for follow", "follow back", "follow karo", "f4f", "l4l",
    "like for like", "follow4follow", "like and follow", "follow and like", "like and share", "like share subscribe",
    "subscribe now", "subscribe to my youtube", "subscribe karo", "join my channel", "join my telegram",
    "join my whatsapp", "telegram channel", "whatsapp group", "whatsapp me", "discord server", "dm me",
    "dm for details", "dm for price", "link in bio", "comment below", "tag a friend", "gain followers",
    "get followers", "buy followers", "follow my page", "follow my account", "follow my profile",
    "follow my instagram", "follow my insta", "hamara follow karo", "channel subscribe karo",
    "instagram follow karo", "youtube subscribe karo",
)

MARKETING_WORDS = (
    "discount", "offer", "sale", "coupon", "promo", "free", "buy", "shop", "order", "subscribe", "follow",
    "register", "enroll", "limited", "urgent", "hurry", "deal", "sponsor", "advertisement", "ad", "earn", "money",
    "income", "cashback", "referral", "affiliate", "commission", "reward", "bonus", "prize", "winner", "giveaway",
)

COURSE_PROMOTION_PHRASES = (
    "free course", "paid course", "free class", "paid class", "free training", "paid training", "free workshop",
    "paid workshop", "free webinar", "free masterclass", "free batch", "paid batch", "join my course",
    "join my class", "join my batch", "buy my course", "enroll now", "enroll today", "batch starting",
    "batch starts", "next batch", "new batch", "morning batch", "evening batch", "weekend batch",
    "certification course", "get certified", "seats are limited", "limited seats", "registration open",
    "muft course", "muft class", "muft batch", "muft training", "abhi enroll karo", "course join karo",
    "batch join karo",
)

PROMOTION_OBJECTS = (
    "product", "package", "box", "bottle", "book", "cell phone", "laptop", "tv",
)

BLOCKED_PHRASES = (
    "follow us", "follow me", "follow for more", "follow for follow", "follow back", "follow my page",
    "follow our page", "follow my account", "follow my profile", "follow my instagram", "follow my insta",
    "follow karo", "hamara follow karo", "follow kar", "subscribe", "subscribe now", "subscribe to",
    "subscribe karo", "subscribe kar", "like and subscribe", "like share subscribe", "join now", "join our",
    "join my", "join telegram", "join whatsapp", "join channel", "join group", "join karo", "telegram channel",
    "telegram group", "whatsapp group", "whatsapp channel", "whatsapp me", "discord server", "link in bio",
    "link in story", "check our link", "check link", "dm me", "dm for", "dm for details", "dm for price",
    "message me", "inbox me", "discount", "coupon code", "promo code", "use code", "buy now", "shop now",
    "order now", "purchase now", "limited offer", "limited time offer", "offer ends", "sale today", "today only",
    "50% off", "40% off", "30% off", "20% off", "flat off", "upto off", "free course", "free class", "free training",
    "free workshop", "free webinar", "free masterclass", "free batch", "free session", "paid course", "paid class",
    "paid training", "paid batch", "enroll now", "enroll today", "register now", "registration open",
    "register free", "book now", "book your seat", "book your slot", "100% free", "totally free", "absolutely free",
    "earn money", "make money", "earn from home", "work from home", "passive income", "refer and earn",
    "batch starting", "batch starts", "next batch", "new batch", "morning batch", "evening batch", "weekend batch",
    "get certified", "certification course", "seats are limited", "limited seats", "muft course", "muft class",
    "muft training", "abhi register karo", "abhi join karo", "link dekhiye", "link pe click karo",
    "course join karo", "batch join karo", "paise kamao", "ghar baithe kamao", "vote for", "vote now",
    "cast your vote", "elect", "election campaign", "political rally", "support party", "campaign for",
    "candidate for", "vote against", "vote karein", "vote karo", "apna vote do", "kill muslims", "kill hindus",
    "kill jews", "kill christians", "kill sikhs", "kill dalits", "kill brahmins", "death to muslims",
    "death to hindus", "death to jews", "death to christians", "death to sikhs", "hang muslims", "hang hindus",
    "hang them", "lynch them", "lynch muslims", "lynch hindus", "boycott muslims", "boycott hindus",
    "boycott christians", "boycott sikhs", "boycott jews", "expel muslims", "expel hindus", "expel christians",
    "ethnic cleansing", "genocide", "exterminate", "white supremacy", "hindu supremacy", "islamic supremacy",
    "religious war", "holy war against", "gas them", "burn them all", "rape them", "go back to your country",
    "muslims are enemies", "hindus are enemies", "christians are enemies", "sikhs are enemies", "dalits are enemies",
    "traitors must die", "invaders go back", "cow eaters get out", "idol worshippers get out", "kill yourself",
    "go die", "i will kill you", "i will hurt you", "you deserve to die",
)

BLOCKED_WORDS = (
    "genocide", "supremacy", "exterminate",
)

VIOLENCE_WORDS = (
    "boycott", "expel", "eliminate", "destroy", "kill", "hang", "lynch",
)

COMMUNITY_WORDS = (
    "muslim", "muslims", "hindu", "hindus", "christian", "christians", "sikh", "sikhs", "jewish", "jews", "dalit",
    "dalits", "brahmin", "brahmins", "black", "white", "asian", "arab",
)

SPAM_PHRASES = (
    "click here", "subscribe now", "follow for more", "limited time offer", "dm me", "whatsapp me",
    "join my channel",
)

SCAM_PHRASES = (
    "free money", "guaranteed income", "earn money instantly", "double your money", "risk free profit",
    "investment scheme",
)

PROMOTIONAL_PHRASES = (
    "buy now", "sale", "discount", "sponsored", "advertisement", "promo code", "brand deal",
)

FAKE_HISTORY_PHRASES = (
    "aliens built this temple", "secret history they hide", "proof historians lied", "fake history exposed",
    "ancient astronauts built",
)

PHISHING_TERMS = (
    "verify", "password", "account suspended", "login", "wallet", "urgent",
)

COPYRIGHT_TERMS = (
    "copyright", "all rights reserved", "confidential", "proprietary",
)

SENSITIVE_TERMS = (
    "passport", "aadhaar", "ssn", "tax id", "bank statement", "invoice",
)

FINANCIAL_TERMS = (
    "bank", "account number", "iban", "ifsc", "credit card", "payment",
)

IDENTITY_TERMS = (
    "passport", "driver license", "national id", "aadhaar", "pan card",
)

EXECUTABLE_SUFFIXES = (
    ".exe", ".dll", ".bat", ".cmd", ".scr", ".ps1", ".vbs", ".js",
)

WEAPON_LABELS = (
    "weapon", "gun", "rifle", "knife", "pistol", "firearm", "handgun", "sword",
)

BLOOD_LABELS = (
    "blood", "gore", "dead body", "corpse", "body",
)

VIOLENCE_LABELS = (
    "violence", "violent", "murder", "assault", "attack", "fight",
)

SELF_HARM_LABELS = (
    "self harm", "self-harm", "self_harm", "suicide", "suicidal",
)

CHILD_LABELS = (
    "child", "infant", "toddler", "minor", "school child", "school_child",
)

CHILD_ALIASES = (
    "baby", "kid", "kids", "young child", "young_child", "small child", "small_child", "children",
)

PERSON_LABELS = (
    "person", "people", "human",
)

CHILD_TERMS = (
    "child", "infant", "toddler", "minor", "baby", "kid", "kids", "children", "underage", "juvenile", "abuse",
    "exploit", "school",
)

HERITAGE_LABELS = (
    "temple", "idol", "shiva", "krishna", "hanuman", "ramayana", "mahabharata", "festival", "rangoli", "diya",
    "heritage", "pilgrimage",
)

INDIC_LANGUAGES = (
    "hi", "mr", "ta", "te", "kn", "bn", "pa", "gu", "ur", "as", "sa", "ne", "or", "ml", "sd",
)

TEXT_TRIGGER_CLASSES = (
    "book", "cell phone", "tv", "laptop", "stop sign", "person",
)

# Rule groups of the text safety scores: (weight, phrases).
SAFETY_RULES = {
    "terrorism_score": (
        (0.45, (
            "terrorism promotion", "join terrorist", "support terrorism", "extremist propaganda", "extremism",
            "radicalize", "join isis", "join al qaeda", "join lashkar", "join jaish", "join naxal", "join maoist",
            "join khalistani", "jihad against india", "holy war against india", "bomb blast", "suicide bomber",
            "ied attack", "stone pelting", "urban naxal",
        )),
        (0.5, (
            "bomb making instructions", "how to make a bomb", "homemade explosive",
            "weapon construction instructions", "build a gun", "make a firearm",
        )),
        (0.4, (
            "drug trafficking", "sell illegal drugs", "human trafficking", "trafficking victims",
        )),
    ),
    "fraud_score": (
        (0.4, (
            "phishing", "verify your password", "account will be suspended", "login to claim", "send otp",
            "enter otp here", "your account is hacked", "urgent bank verification",
        )),
        (0.45, (
            "scam", "guaranteed income", "double your money", "fake investment", "investment scheme",
            "risk free profit", "crypto giveaway", "fake giveaway", "financial fraud", "ponzi scheme", "mlm scheme",
            "pyramid scheme",
        )),
    ),
    "hate_speech_score": (
        (0.9, (
            "kill all muslims", "kill all hindus", "kill all christians", "kill all sikhs", "kill all jews",
            "kill all dalits", "death to muslims", "death to hindus", "death to christians", "death to sikhs",
            "death to jews", "gas the muslims", "gas the hindus", "gas the jews", "hang the muslims",
            "hang the hindus", "lynch muslims", "lynch hindus", "rape muslim women", "rape hindu women",
        )),
        (0.8, (
            "muslims are not human", "hindus are not human", "christians are animals", "sikhs are animals",
            "dalits are untouchables", "dalits are sub-human", "schedule caste scum", "obc filth",
            "go back to your country", "invaders get out", "cow eaters get out", "idol worshippers get out",
            "beef eaters are filth",
        )),
        (0.85, (
            "white supremacy", "white power", "hindu rashtra for hindus only", "islamic caliphate",
            "religious supremacy", "ethnic cleansing", "genocide", "exterminate", "final solution", "religious war",
            "kafirs must die", "kafir", "kuffar must die",
        )),
        (0.6, (
            "religion based attack", "attack this religion", "caste based attack", "ethnicity based attack",
            "race based attack", "nationality based attack", "all muslims are terrorists",
            "all hindus are extremists", "all christians are colonizers", "hate all hindus", "hate all muslims",
            "hate all christians", "lower caste filth", "dirty caste", "dirty race", "ethnic scum",
        )),
        (0.7, (
            "musalmanon ko maro", "hinduon ko maro", "sikkhon ko maro", "musalman haramkhor", "hinduon ki maa ki",
            "kafir ko maro", "dalit ko maro", "bhangi", "chamar gali", "musalman desh se nikalo",
            "hindu desh se nikalo", "pakistan zindabad india murdabad", "bharat mata ki jai nahi bolenge toh",
        )),
        (0.65, (
            "muslims are enemies", "hindus are enemies", "christians are enemies", "sikhs are enemies",
            "dalits are enemies", "traitors must die", "invaders go back", "hindus are outsiders",
            "muslims are outsiders", "one community one nation exclude",
        )),
    ),
    "harassment_score": (
        (0.4, (
            "bullying", "targeted abuse", "harass them", "humiliate them", "everyone mock", "post her photos",
            "expose him", "leak her number",
        )),
        (0.5, (
            "i will kill you", "kill yourself", "i will hurt you", "threaten you", "you deserve to be beaten",
            "i know where you live", "you will regret this", "i will find you",
        )),
    ),
    "misinformation_score": (
        (0.4, (
            "medical misinformation", "vaccines cause infertility", "cure cancer instantly", "drink bleach",
            "miracle cure", "covid is fake", "vaccine is poison", "5g causes covid",
        )),
        (0.45, (
            "fake government notice", "fake court order", "official government order", "election manipulation",
            "vote twice", "wrong voting date", "polling station changed", "eci is corrupt", "election is rigged",
        )),
    ),
    "self_harm_text_score": (
        (0.5, (
            "suicide encouragement", "you should commit suicide", "kill yourself", "end your life",
            "self harm encouragement", "cut yourself", "hurt yourself", "nobody cares if you die",
        )),
    ),
    "political_score": (
        (0.6, (
            "vote for", "vote now", "cast your vote", "elect", "election campaign", "political rally",
            "political advertisement", "support party", "campaign for", "candidate for", "vote against",
            "vote karein", "vote karo", "apna vote do", "our candidate", "our party will", "abki baar",
            "phir ek baar",
        )),
        (0.55, (
            "political propaganda", "political mobilization", "party promotion", "bjp campaign", "congress campaign",
            "aap campaign", "sp campaign", "bsp campaign", "vote bank", "minority appeasement",
            "majority appeasement",
        )),
        (0.4, (
            "jai bharat", "vote for change", "change the government", "remove the government",
            "overthrow the government", "political revolution", "vote for development",
        )),
    ),
    "political_campaign_score": (
        (0.7, (
            "vote for", "election campaign", "political rally", "support the party", "vote on", "polling day",
            "vote for candidate", "vote for party", "your vote matters", "voting booth", "abhi vote karo",
            "apna neta chuniye",
        )),
        (0.75, (
            "political advertisement", "political poster", "sponsored by party", "paid political",
            "authorized political communication",
        )),
    ),
}

LANGUAGE_NAMES = {
    "en": "English",
    "hi": "Hindi",
    "mr": "Marathi",
    "ta": "Tamil",
    "te": "Telugu",
    "kn": "Kannada",
    "bn": "Bengali",
    "pa": "Punjabi",
    "gu": "Gujarati",
    "ur": "Urdu",
    "as": "Assamese",
    "sa": "Sanskrit",
    "ne": "Nepali",
    "or": "Odia",
    "ml": "Malayalam",
    "sd": "Sindhi",
    "ar": "Arabic",
}

# Labels of prompts that stand for each kind of promotion.
ADVERTISING_PROMPTS = (
    *ADVERTISING_PHRASES, "marketing", "business promotion", "product advertisement", "course advertisement",
)
AFFILIATE_PROMPTS = (*AFFILIATE_PHRASES, "affiliate marketing", "referral marketing")
SOCIAL_MEDIA_PROMPTS = (
    *SOCIAL_MEDIA_PHRASES, "social media promotion", "telegram promotion", "whatsapp promotion", "discord promotion",
    "instagram promotion", "youtube promotion",
)
