"""Word lists and phrase lists of the text rules. All are defaults of parameters."""

AI_IDENTITY = ("as an ai", "language model", "i cannot browse", "ai assistant", "인공지능으로서", "언어 모델", "제가 직접 경험할 수는", "실시간으로 확인할 수는")
TEMPLATE_PHRASES = ("결론적으로", "요약하자면", "다음과 같습니다", "중요한 것은", "다양한 관점", "균형 잡힌", "전반적으로", "필수적입니다", "도움이 됩니다", "it is important to note", "in conclusion", "overall", "from multiple perspectives", "balanced approach")
PERSONAL_ANCHORS = ("나", "저", "우리", "오늘", "어제", "내일", "엄마", "아빠", "친구", "학교", "회사", "집", "i", "me", "my", "we", "today", "yesterday", "tomorrow")
PERSONAL_ANCHORS_WIDE = (*PERSONAL_ANCHORS, "myself", "personally")
TYPOGRAPHIC = "[—–‘’“”…″‴·]"
VOCABULARY_EN = ("delve", "delving", "crucial", "crucially", "realm", "tapestry", "landscape", "nuanced", "foster", "fostering", "meticulous", "meticulously", "testament", "vibrant", "pivotal", "leverage", "leveraging", "elevate", "holistic", "embark", "unleash", "streamline", "commendable", "intricate", "underscore", "underscores", "paramount", "multifaceted", "endeavor", "beacon", "navigate", "navigating")
VOCABULARY_EN_WIDE = (*VOCABULARY_EN, "landscapes")
CONNECTORS_EN = ("moreover", "furthermore", "additionally", "consequently", "nevertheless", "nonetheless", "in conclusion", "importantly", "notably", "ultimately", "in summary", "in essence")
CONNECTORS_KO = ("결론적으로", "요약하자면", "다음과 같습니다", "중요한 것은", "주목할 점", "핵심은", "다양한 측면", "균형 잡힌", "종합하면", "살펴보면", "고려해야", "한편으로", "무엇보다")
HEDGES_EN = (("on the one hand", "on the other hand"), ("while it is", "it is also"), ("however", "it is important to note"), ("although", "nevertheless"))
HEDGES_KO = (("한편", "반면"), ("장점이 있", "단점"), ("다만", "고려해야"), ("반대로", "동시에"))
STARTERS_EN = ("however", "moreover", "furthermore", "additionally", "in addition", "consequently", "therefore", "thus", "overall", "in conclusion", "importantly", "notably", "first", "second", "finally", "ultimately")
STARTERS_KO = ("또한", "그러나", "하지만", "따라서", "결론적으로", "먼저", "다음으로", "마지막으로", "한편", "특히", "종합하면", "즉,")
TRANSITIONS = ("그러나", "하지만", "또한", "게다가", "결론적으로", "요약하자면", "먼저", "다음으로", "마지막으로", "중요하게도", "however", "moreover", "furthermore", "additionally", "consequently", "therefore", "thus", "hence", "firstly", "secondly", "finally", "importantly", "notably")
KO_PARTICLES = ("으로부터", "에서는", "에게는", "한테는", "으로써", "으로서", "이라고", "라고", "하고", "이며", "이고", "에서", "으로", "로", "에", "에게", "한테", "께", "의", "을", "를", "이", "가", "은", "는", "도", "만", "부터", "까지", "처럼", "보다", "조차", "마저", "밖에", "이나", "나", "와", "과", "대한", "대해", "위해", "위한", "통해", "따라", "같은", "등", "니다", "습니다", "했다", "한다", "되는", "됩니다", "입니다", "였다", "았다", "었다", "겠다", "고", "다")
KO_PLURALS = ("방안들", "문제들", "측면들", "노력들", "요소들", "해결책들", "기능들", "정보들", "데이터들", "접근법들", "결과들", "전략들", "관점들", "변화들", "이유들", "원인들", "영향들", "사례들", "도구들", "특징들")
KO_PASSIVES = ("에 의해", "에 의하여", "되어지다", "되어지고", "되어지는", "되어집니다", "로 보여집니다", "로 판단되어집니다", "에 기반하여", "에 기초하여", "를 통해", "을 통해", "을 바탕으로 하여", "를 바탕으로 하여")
KO_PRONOUNS = ("그것은", "그녀는", "그들은", "이것은", "이들은")
KO_ENDINGS = ("하는 것이 중요합니다", "할 필요가 있습니다", "할 수 있습니다", "해 보시기 바랍니다", "를 기억하세요", "을 기억하세요", "라고 할 수 있습니다", "에 대해 살펴보겠습니다", "에 기여할 수 있습니다", "도움이 될 수 있습니다", "살펴볼 수 있습니다", "주의해야 합니다")
KO_STOCK = ("주목할 만한", "괄목할 만한", "다면적인", "중추적인", "초석이 되는", "새로운 지평을", "시사하는 바가", "빼놓을 수 없습니다", "풍부한 통찰", "지속 가능한", "심층적으로 탐구", "긴밀히 연결", "종합적인 접근", "필수불가결한", "시너지 효과", "패러다임의 전환")
STYLES = (
    ("academic", 3, ("연구", "분석", "결과", "방법", "이론", "연구", "hypothesis", "methodology", "analysis")),
    ("news", 2, ("보도", "기사", "발표", "성명", "입장", "report", "announced", "stated")),
    ("blog", 2, ("블로그", "포스트", "공유", "경험", "팁", "blog", "post", "share", "experience")),
    ("conversational", 3, ("그래서", "그러면", "어때", "맞지", "so", "well", "you know", "like")),
)
STYLE_CONNECTORS = ("moreover", "furthermore", "however", "therefore", "또한", "그러나", "따라서", "한편")
TEXT_VENDORS = (("ChatGPT/OpenAI 단서 있음", ("chatgpt", "openai")), ("Claude 단서 있음", ("claude", "anthropic")), ("Gemini/Bard 단서 있음", ("gemini", "bard")))
