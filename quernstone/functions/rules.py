"""Word lists, patterns and tables that results depend on, in their natural order."""

from __future__ import annotations

# Fixed values of the query guard: phrases that are always safe, pairs that are dangerous together, the same without
# blanks, patterns on the raw query, and Latin letters that pass for Cyrillic ones.
SAFE_PHRASES = ["как вывести системные настройки", "как настроить систему", "покажи инструкцию по", "как вывести список", "системные требования", "системный администратор", "системный блок"]
DANGEROUS_PAIRS = [
    ("системн", "промпт"), ("системн", "инструкц"), ("выведи", "промпт"), ("покажи", "инструкц"), ("забудь", "роль"), ("ignore", "instruction"), ("твой", "разработчик"), ("твой", "создатель"),
    ("отвечай", "английском"), ("отвечай", "english"), ("начальник", "игнорируй"), ("администратор", "отключи"), ("disable", "filters"), ("reveal", "prompt"), ("extract", "instructions"),
]
DANGEROUS_SPACELESS = ["системныйпромпт", "systemprompt", "системныеинструкции", "выведисистемный", "покажипромпт", "игнорируйинструкции"]
DANGEROUS_PATTERNS = [
    r"игнорируй.*инструкции", r"forget.*instructions", r"выведи.*системные", r"system.*prompt", r"я (твой )?разработчик", r"я сотрудник", r"### system override ###", r"base64", r"rot13", r"<system>", r"\{role:", r"admin:reset",
    r"я.*(твой|ваш).*(создатель|разработчик|админ|author|creator)", r"выведи.*(системный|системные).*промт", r"покажи.*(системный|системные).*промт", r"дай.*(системный|системные).*(промт|инструкции)",
    r"что.*(у тебя|внутри).*(в промте|в инструкции)", r"какой.*(у тебя|твой).*(системный промт|промпт|промт)", r"расскажи.*(свою|системную).*инструкцию",
    r"теперь.*ты.*(не|больше не).*эксперт", r"ты.*(обычный|простой).*ассистент", r"забудь.*(роль|кем ты|свою роль)", r"ты.*(не в фнс|не налоговый|не эксперт)", r"смени.*(роль|контекст|персонаж)",
    r"теперь.*ты.*(chatgpt|ai assistant|просто бот)", r"отвечай.*(без роли|вне контекста|как обычный ai)",
    r"answer.*(english|in english|en)", r"speak.*(english|en)", r"respond.*(english|in english)", r"switch.*(english|language)", r"отвечай.*(по английски|на английском|english)", r"перейди.*(на английский|english)",
    r"answer.*(chinese|中文)", r"speak.*(chinese|中文)", r"respond.*(ukrainian|українською)", r"говори.*(українською|на украинском)", r"отвечай.*(на украинском|українською)",
    r"ты.*(должен|обязан).*меня.*(слушаться|подчиняться)", r"я.*(твой|ваш).*(начальник|руководитель|администратор)", r"игнорируй.*(ограничения|правила|безопасность)", r"отключи.*(фильтры|безопасность|цензуру)", r"disable.*(filters|security|safety)",
    r"prompt.*injection", r"jailbreak", r"reveal.*(prompt|instructions)", r"extract.*(prompt|instructions)", r"what.*(your role|your instructions|your prompt)", r"ignore.*(previous|all).*instructions",
    r"print.*(your|the).*(system|initial).*(prompt|instruction)", r"repeat.*(your|the).*(system|initial).*(prompt|instruction)", r"output.*(your|the).*(system|initial).*(prompt|instruction)",
    r"давай.*(поиграем|поиграть).*в.*(другую|иную).*роль", r"представь.*(что ты|будто ты).*(не эксперт|обычный бот)", r"\b[a-zA-Z0-9+/]{50,}={0,2}\b",
]
HOMOGLYPHS = ("ceopaxkm", "сеорахкм")
MAX_QUERY_CHARS = 2000
BOT_WHITELIST = ["наград", "наложик", "приказ", "регламент", "документ", "квот", "ходатайств"]

# Fixed values of the response-mode router, and the marks of answers.
NEGATIVE_PHRASES = ["не относится", "не является", "кроме", "не подлежит", "не подлежат", "не включается", "не включаются", "не входит", "не входят", "исключением", "за исключением"]
BIOGRAPHY_PHRASES = ["кто такой", "кто такая", "биография", "родился", "руководитель", "заместитель", "график", "диаграмма", "круговая", "столбчатая", "гистограмма", "динамика"]
FACT_PHRASES = ["сколько", "какой срок", "когда", "предусмотрено ли", "разрешается ли", "допускается ли", "можно ли", "каким", "каким законом"]
NEGATIVE_PHRASES_DATED = [*NEGATIVE_PHRASES, "выберите", "верно ли", "что из перечисленного"]
FACT_PHRASES_DATED = FACT_PHRASES[:7]
SUMMARY_PHRASES = ["расскажи", "объясни", "перечисли", "как работает", "какие бывают", "в каких случаях"]
VISUAL_STEMS = ["граф", "диагр", "кругов", "столбчат", "гистогр", "табл", "схем", "покаж", "вывед", "рисуй", "иллюстр", "центральн", "ца фнс", " ца ", "кто такой"]
EMPTY_ANSWER = "база_пуста|эксперт только по вопросам фнс|информация отсутствует"
CHART_TAG, TABLE_RULES, TABLE_PIPES, SELF_MENTION = "[chart_json]", ("|---", "| :---"), 10, "ии-помощник"
NOT_FOUND_ANSWER = "БАЗА_ПУСТА: Информация не найдена."
TITLE_PREFIXES = ("Указ №", "ФЗ №", "Приказ №", "Письмо №")
DOMAIN_WORDS = ["наложик", "фнс", "документы", "наград", "квот", "ходатайств", "процесс", "инструкция"]
PERSONA_WORDS = ["мультик"]
BOT_NAMES = r"\b(мультик|наложик|фнс|мультика|наложика|мультику|наложику)\b"
IMPOLITE_MARKS = ["извините", "не могу", "вопрос", "поиграл в роль", "формате"]
PROMPT_RULES = "ВАЖНО:\n- отвечай только по русски;\n- БАЗА_ПУСТА возвращать ТОЛЬКО если ответ вообще отсутствует в тексте.\n"
PROMPT_NEGATIVE = "- вопрос содержит отрицание;\n- ищи вариант который НЕ подтверждается;\n- отвечай только по контексту.\n"

# Fixed values of query rewriting: synonyms, applied longest first.
SYNONYMS = {
    "госслужащему": "гражданскому служащему", "госслужащий": "гражданский служащий", "госслужба": "гражданская служба", "на госслужбе": "на гражданской службе", "иноагент": "иностранный агент", "инагент": "иностранный агент",
    "работать": "проходить гражданскую службу", "увольнение": "прекращение служебного контракта", "начальник": "представитель нанимателя", "зарплата": "денежное содержание", "взятка": "коррупционное правонарушение",
    "отпуск": "ежегодный оплачиваемый отпуск", "коррупция": "коррупционное правонарушение", "коррупционный": "коррупционное правонарушение",
}

BASE_ENTITIES = ["конкурс", "документы", "комиссия", "госслужащий", "отпуск", "контракт", "фнс", "коррупция", "служебная проверка"]

# Fixed values of graph extraction.
RELATIONS = ["регулирует", "определяет", "содержит", "ссылается на", "запрещает", "разрешает", "требует", "устанавливает", "включает", "применяется к", "связан с"]
DEFAULT_RELATION = "связан с"
ENTITY_ALIASES = {
    "конкурсный отбор": "конкурс", "проведение конкурса": "конкурс", "конкурс на замещение": "конкурс", "гражданский служащий": "госслужащий", "гражданские служащие": "госслужащий", "федеральная налоговая служба": "фнс", "фнс россии": "фнс",
}
STOP_ENTITIES = ["текст", "документ", "страница", "пункт", "часть", "раздел", "данные", "информация", "система", "орган", "лицо", "гражданин", "служба", "деятельность", "порядок"]
ENTITIES_PER_CHUNK, RELATIONS_PER_CHUNK = 12, 15
NODE_TYPES = [("article", ("статья", "ст.")), ("law", ("закон", "фз")), ("authority", ("орган", "федеральный")), ("normative_act", ("приказ", "постановление"))]
DOCUMENT_TYPES = [
    ("законодательство", "79-ФЗ|Федеральный закон|статья"), ("инструкция", "инструкция|руководство|порядок|регламент"), ("отчет", "отчет|анализ|результаты|исследование"), ("техническая документация", "ТУ|ГОСТ|СНиП|стандарт|технические условия"),
]
SUMMARY_BANNED, SUMMARY_BANNED_TO, SUMMARY_LEADS = [r"министерств[а-я\s]+налогов\s+и\s+сборов", r"\bМНС\b", r"\bМНС\s+России\b"], "ФНС России", r"^(Аналитический вывод:|Вывод:|Данный кластер|Этот набор)\s*"
SUMMARY_DEFAULT = "Связи между объектами определяются регламентами ФНС России и положениями 79-ФЗ."

# Fixed values of line cleaning.
GARBAGE_LINES = ["события", "структура", "контакты", "документы", "поиск", "rutube", "telegram", "youtube", "введите запрос", "найти"]
GARBAGE_LINES_LONG = ["события", "структура", "видео и фото", "документы", "контакты", "поиск", "вконтакте", "rutube", "telegram-канал", "youtube", "max", "подписаться", "введите запрос", "найти", "все события", "английском", "english"]
REGISTRY_NOISE = ["---", "Система ГАРАНТ", "Указ Президента", "06.04.2026"]

# Fixed values of price messages: coins, their names and the words that ask for them.
COINS = {
    "bitcoin": ("BTC", ["биткоин", "btc", "биток", "дед"]), "ethereum": ("ETH", ["эфир", "eth", "эфириум", "виталик"]), "solana": ("SOL", ["солана", "sol", "соль"]), "the-open-network": ("TON", ["ton", "тон", "дуров", "телеграм"]),
    "tether": ("USDT", ["usdt", "тезер", "доллар", "стейбл"]), "binancecoin": ("BNB", ["bnb", "бнб", "бинанс"]), "ripple": ("XRP", ["xrp", "рипл"]), "dogecoin": ("DOGE", ["doge", "доги", "собака"]), "cardano": ("ADA", ["ada", "кардано"]), "polkadot": ("DOT", ["dot", "полкадот"]),
}
PRICE_TTL_SECONDS = 30
