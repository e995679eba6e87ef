"""Fixed values of the text rules: what is replaced by what, in the order that it has to be done in.

A line is ``found > put``. Rules that would change nothing are left out. All values must be exactly these for right results.
"""

#: Misread words and phrases, replaced as they stand.
MISREAD = """
마이름상어 > 마이클 싱어
마이클 상어 > 마이클 싱어
마이칼 심어 > 마이클 싱어
마이름생어 > 마이클 싱어
원프리 > 윈프리
소율 > 소울
곧경 > 곤경
상어든 > 싱어는
토니 페반스 > 토니 에반스
아리스토딸레스 > 아리스토텔레스
니채 > 니체
스플노자 > 스피노자
로크 > 록
휴럼 > 흄
컨트 > 칸트
샤르트르 > 사르트르
비트겐슈나인 > 비트겐슈타인
러설 > 러셀
프롯드 > 프로이트
매슬로우 > 매슬로
로져스 > 로저스
다든 > 다윈
아인슈나인 > 아인슈타인
뉴튼 > 뉴턴
갈릴래이 > 갈릴레이
쏘크라딱 > 소크라테스
프랏톤 > 플라톤
데이빗 > 데이비드
리차드 > 리처드
기틀 > 기를
부탁울 > 부탁을
이기 지 > 이기지
자유로위지 > 자유로워지
을컷고 > 올랐고
소개되워 > 소개되었
두없던 > 두었던
우리튼 > 우리를
그이후 > 그 이후
돌두했 > 돌입했
깊은내면 > 깊은 내면
드러넷 > 드러냈
알려저 > 알려져
지처 > 지쳐
에대한 > 에 대한
에관한 > 에 관한
에따른 > 에 따른
에의한 > 에 의한
에있어서 > 에 있어서
에비해 > 에 비해
에반해 > 에 반해
으로인한 > 으로 인한
에도불구하고 > 에도 불구하고
이기때문에 > 이기 때문에
하기때문에 > 하기 때문에
되기때문에 > 되기 때문에
할수있는 > 할 수 있는
될수있는 > 될 수 있는
갈수있는 > 갈 수 있는
오고있는 > 오고 있는
가고있는 > 가고 있는
하고있는 > 하고 있는
되어있는 > 되어 있는
습니짜 > 습니다
슴니다 > 습니다
하십시요 > 하십시오
해주십시요 > 해주십시오
말씀하십시요 > 말씀하십시오
드리겠솜 > 드리겠습
하겠슴니다 > 하겠습니다
되겠슴니다 > 되겠습니다
있겠솜니다 > 있겠습니다
이겠솜니다 > 이겠습니다
그렇솜니다 > 그렇습니다
맞솜니다 > 맞습니다
좋솜니다 > 좋습니다
감사함니다 > 감사합니다
고맙솜니다 > 고맙습니다
미안함니다 > 미안합니다
어떻게지내십니까 > 어떻게 지내십니까
했었솜니다 > 했었습니다
할것이다 > 할 것이다
될것이다 > 될 것이다
갈것이다 > 갈 것이다
할것일까 > 할 것일까
할것인가 > 할 것인가
할것같다 > 할 것 같다
할지도모른다 > 할지도 모른다
할지모른다 > 할지 모른다
하지않을 > 하지 않을
하지않는 > 하지 않는
하지않았 > 하지 않았
하지못한 > 하지 못한
하지못했 > 하지 못했
할수없는 > 할 수 없는
할수없다 > 할 수 없다
오- > 으
울- > 을
블 > 를
엔 > 에
올 > 을
느- > 는
겨- > 게
끠 > 께
웁 > 위
셨 > 세
함들은 > 람들은
쾌습니다 > 했습니다
햇습니다 > 했습니다
국업는 > 숭배의
토록 > 도록
빋다 > 빚다
살펴봐야함 > 살펴봐야 함
해야합 > 해야 함
될것같 > 될 것 같
할것같 > 할 것 같
갈것같 > 갈 것 같
올것같 > 올 것 같
보여주긴 > 보여주길
가져다주 > 가져다 주
그렇하니 > 그렇다니
안녕히가세요 > 안녕히 가세요
안녕히계세요 > 안녕히 계세요
잘지내세요 > 잘 지내세요
화이팅하세요 > 화이팅 하세요
하나너 > 하나님
사악 > 사람
내숭 > 내용
세제 > 세계
인갑 > 인간
쳬험 > 체험
현젠 > 현실
철혁 > 철학
심러학 > 심리학
사회혁 > 사회학
경제혁 > 경제학
정치혁 > 정치학
역사혁 > 역사학
문화혁 > 문학
예술혁 > 예술학
종교혁 > 종교학
논러학 > 논리학
윤러학 > 윤리학
미해학 > 미학
Michacl > Michael
Sinyer > Singer
Uniyerse > Universe
teh > the
adn > and
hte > the
OGettylmages > @GettyImages
Philosophly > Philosophy
Psycholgoy > Psychology
Sociolgoy > Sociology
Politcal > Political
Histroy > History
Literatrue > Literature
Scienec > Science
Religon > Religion
Economcs > Economics
"""

#: Single characters and words with a misread character. The digits hold between Latin letters only, unless asked for everywhere.
CHARACTERS = """
헬 > 할
듀 > 두
옷 > 것
내숭 > 내용
세제 > 세계
했슴니다 > 했습니다
있슴니다 > 있습니다
없슴니다 > 없습니다
몽 > 목
뜨 > 때
롱 > 로
묘 > 며
휴 > 휘
0 > o
1 > l
5 > S
업다 > 없다
잆다 > 있다
죄 > 좌
심리혁 > 심리학
사회혁 > 사회학
정치혁 > 정치학
경제혁 > 경제학
"""

#: Misread characters within a phrase.
PHRASES = """
헐 수 있 > 할 수 있
헤 수 있 > 할 수 있
혼 수 있 > 할 수 있
그옷은 > 그것은
그옷이 > 그것이
그옷을 > 그것을
뜨문에 > 때문에
때운에 > 때문에
때분에 > 때문에
몽적 > 목적
목젹 > 목적
사앰들 > 사람들
사럼들 > 사람들
했슴 > 했습
있슴 > 있습
없슴 > 없습
됩슴 > 됩습
"""

#: The wider table of the second pipeline, full-width punctuation included.
EXTENDED = """
마이름상어 > 마이클 싱어
마이클상어 > 마이클 싱어
마이칼심어 > 마이클 싱어
원프리 > 윈프리
소율 > 소울
곧경 > 곤경
상어든 > 싱어는
기틀 > 기를
부탁울 > 부탁을
자유로위지 > 자유로워지
을컷고 > 올랐고
소개되워 > 소개되었
두없던 > 두었던
우리튼 > 우리를
그이후 > 그 이후
돌두했 > 돌입했
깊은내면 > 깊은 내면
드러넷 > 드러냈
알려저 > 알려져
지처 > 지쳐
되워 > 되어
겨져 > 겪어
하나너 > 하나님
사악 > 사람
내숭 > 내용
세제 > 세계
인갑 > 인간
부족할 > 부족한
쳬험 > 체험
현젠 > 현실
사뭄들 > 사람들
이여기 > 이야기
설각 > 생각
가슴속 > 가슴 속
2o1g > 2019
2o2o > 2020
2o21 > 2021
2o22 > 2022
1o > 10
1oo > 100
1ooo > 1000
， > ,
； > ;
： > :
？ > ?
！ > !
（ > (
） > )
［ > [
］ > ]
｛ > {
｝ > }
teh > the
adn > and
hte > the
youer > your
Michacl > Michael
Sinyer > Singer
Uniyerse > Universe
"""

#: Terms of the third pipeline.
TERMS = """
명상 가로 > 명상가로
숲 속의 명상 > 숲속의 명상
마 이글 > 마이클
플로리다 대학교 > 플로리다대학교
경제학 박사 과정 > 경제학 박사과정
내면 적 > 내면적
세속 적 > 세속적
내 적 > 내적
폭발 적으로 > 폭발적으로
"""

#: Endings of the third pipeline, replaced anywhere.
PLAIN_ENDINGS = """
하었습니다 > 했습니다
받었습니다 > 받았습니다
지어 > 져
리어 > 려
"""

#: Words whose syllables may stand apart, joined again. A look-ahead after ``|`` has to hold.
JOINED = """
마이클싱어 > 마이클 싱어
마이클 | (?!\\s*싱) > 마이클
오프라윈프리 > 오프라 윈프리
사람들 > 사람들
한국어 > 한국어
철학 > 철학
심리학 > 심리학
중요한 > 중요한
어려운 > 어려운
새로운 > 새로운
유명한 > 유명한
완전히 > 완전히
정말 > 정말
내용 > 내용
방법 > 방법
핵심 > 핵심
바로 > 바로
연구 > 연구
작가 > 작가
언어 > 언어
철학적 > 철학적
사고방식 > 사고 방식
처음으로 > 처음으로
폭발적으로 > 폭발적으로
그래서 > 그래서
따라서 > 따라서
하지만 > 하지만
그러나 > 그러나
그러면 > 그러면
그것 | (?=\\s*이) > 그것
이것 | (?=\\s*이) > 이것
그의 | (?=\\s) > 그의_
시작 > 시작
증가 > 증가
감동 > 감동
이해 > 이해
다룹 > 다룹
하겠습니다 > 하겠습니다
해보겠습니다 > 해보겠습니다
했습니다 > 했습니다
있습니다 > 있습니다
없습니다 > 없습니다
됩니다 > 됩니다
입니다 > 입니다
습니다 > 습니다
모였습니다 > 모였습니다
받았습니다 > 받았습니다
증가했습니다 > 증가했습니다
"""

#: Particles that join the word before them, in this order.
PARTICLES = "은 는 이 가 을 를 의 에 에서 에게 로 으로 와 과 도 만"

#: Joins after the particles.
JOINED_LATER = """
시작해보겠습니다 > 시작해보겠습니다
시작 | (?=\\s*해) > 시작
모였 | (?=\\s*습\\s*니\\s*다) > 모였
읽고 | (?=\\s) > 읽고_
받았 | (?=\\s*습\\s*니\\s*다) > 받았
쉽게 | (?=\\s) > 쉽게_
증가했습니다 > 증가했습니다
"""

#: Words of two syllables that join across a gap.
PAIRS = "그의 이것 그것 모든 다른 같은 이런 그런 어떤"

#: Verb endings before white space, the end or a full stop, question or exclamation mark. ~ stands for syllables before it.
PAST = """
~했었다 > ~했다
~갔었다 > ~갔다
~왔었다 > ~왔다
~봤었다 > ~봤다
~살았었다 > ~살았다
~있었었다 > ~있었다
~없었었다 > ~없었다
~읽었었다 > ~읽었다
~썼었다 > ~썼다
~받았었다 > ~받았다
갔었고 > 갔고
왔었고 > 왔고
했었고 > 했고
봤었고 > 봤고
읽었었고 > 읽었고
받았었고 > 받았고
했었습니다 > 했습니다
갔었습니다 > 갔습니다
왔었습니다 > 왔습니다
있었었습니다 > 있었습니다
썼었습니다 > 썼습니다
읽었었습니다 > 읽었습니다
받았었습니다 > 받았습니다
"""
CONTRACTION = """
되었다 > 됐다
되었습니다 > 됐습니다
하였다 > 했다
하였습니다 > 했습니다
이었다 > 였다
이었습니다 > 였습니다
했댔다 > 했다
갔댔다 > 갔다
~엤다 > ~었다
"""
HONORIFIC = """
~읍니다 > ~습니다
~ㅂ니다 > ~습니다
~슴니다 > ~습니다
하슴니다 > 합니다
해슴니다 > 합니다
하십니다 > 합니다
계십니다 > 있습니다
"""
#: _ stands for a gap of one white space or more; the result has one space.
CONNECTION = """
할_거_다 > 할 거다
할_수_있_다 > 할 수 있다
될_수_있_다 > 될 수 있다
~_을_것 > ~을 것
~_을_때 > ~을 때
~_을_수 > ~을 수
읽_을_것 > 읽을 것
쓸_것 > 쓸 것
~_면_서 > ~면서
~_지_만 > ~지만
~_기_때_문에 > ~기 때문에
"""
STYLE = """
~거야 > ~것이다
~걸 > ~것을
좋네요 > 좋습니다
그래요 > 그렇습니다
~네요 > ~습니다
~에요 > ~입니다
맞아요 > 맞습니다
아니에요 > 아닙니다
괜찮아요 > 괜찮습니다
"""

#: Spoken forms of abbreviations, whole words in any case.
SPOKEN = """
AI > 에이 아이
IT > 아이 티
CEO > 씨 이 오
PDF > 피 디 에프
PC > 피씨
TV > 티비
OK > 오케이
NO > 노
YES > 예스
"""

#: Spoken digits from 1 to 9, and ten.
DIGITS, TEN = "일이삼사오육칠팔구", "십"

#: Words after which a long sentence takes a breath.
BREATHS = ("그리고 하지만 그러나 따라서 즉 또한 또 만약 만일", "때문에 경우에 상황에서")
