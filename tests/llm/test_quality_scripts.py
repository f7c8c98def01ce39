"""Compression bands on text of signs of several bytes: ordinary text stays, noise goes."""

import base64
import random

import pytest
import zstandard

from dugout.llm import quality_bands as Q

# Written for this test.
CHINESE = (
    "清晨的集市还没有完全热闹起来，卖菜的老人把新鲜的青菜一把一把摆好，又在木板上写下今天的价格。"
    "旁边的小店里飘出豆浆的香味，几个学生站在门口等着买早饭，他们一边聊天一边看手里的书。"
    "河边的柳树在风里轻轻摇动，桥上有人骑着自行车慢慢经过，铃声在安静的空气中显得格外清楚。"
    "医院的灯亮了一夜，值班的护士终于可以回家休息，她走得很慢，因为路上的石头昨夜被雨水打湿了。"
    "邮递员送来一封从南方寄来的信，信里说那里的稻田已经变成金黄色，收割的日子快要到了。"
    "老师在黑板上画了一张地图，告诉孩子们这条铁路经过哪些城市，每个城市又有什么样的故事。"
    "傍晚时分，工人们从工厂出来，有的去打球，有的去看望朋友，还有人坐在河堤上钓鱼，直到月亮升起。"
)
JAPANESE = (
    "駅前の小さな喫茶店では、朝早くから常連の客が新聞を読みながらコーヒーを飲んでいる。"
    "店の主人は若いころ船乗りだったそうで、壁には遠い港の写真が何枚も飾ってある。"
    "雨が降り出すと、傘を持たない学生たちが軒下に集まり、昨日の試合の話を始めた。"
    "図書館の二階には古い地図の部屋があり、川の流れが百年のあいだにどう変わったかを調べることができる。"
    "祖母は庭で育てた茄子と胡瓜を籠に入れて、隣の家まで歩いて届けに行くのを楽しみにしている。"
    "夕方になると山の向こうに赤い雲が広がり、子どもたちは自転車を押しながら坂道を帰って来る。"
)
KOREAN = (
    "아침 일찍 시장에 가면 상인들이 과일과 생선을 내놓고 손님을 기다리는 모습을 볼 수 있다. "
    "할머니는 작은 의자에 앉아 마늘을 까면서 지나가는 사람들과 날씨 이야기를 나눈다. "
    "강을 건너는 다리 위에는 자전거를 탄 학생들이 줄을 지어 학교로 향하고 있었다. "
    "도서관 창가 자리에서는 오래된 소설을 읽는 사람과 시험을 준비하는 청년이 나란히 앉아 있다. "
    "비가 그친 뒤 골목에는 젖은 나뭇잎 냄새가 가득했고 고양이 한 마리가 담장 위를 천천히 걸었다. "
    "저녁이 되자 식당마다 불이 켜지고 따뜻한 국물을 찾는 손님들로 거리가 다시 붐비기 시작했다. "
)


@pytest.fixture(scope="module")
def coder():
    return zstandard.ZstdCompressor(level=Q.LEVEL, write_checksum=False, write_content_size=False)


@pytest.mark.parametrize("text", [CHINESE, JAPANESE, KOREAN], ids=["zh", "ja", "ko"])
def test_ordinary_text_is_in_band(coder, text):
    body = text.encode()
    for n in range(100, len(body) + 1, 50):
        assert Q.in_band(coder, body[:n].decode(errors="ignore").encode())[0], n


def test_random_signs_are_out_of_band(coder):
    rng = random.Random(5)
    for signs in (600, 3000):
        for n in (1024, 1536, 2048, 4096, 10_000, 70_000):
            used = rng.sample(range(0x4E00, 0x9FA0), signs)
            noise = "".join(chr(rng.choice(used)) for _ in range(n // 3 + 1)).encode()
            assert not Q.in_band(coder, noise)[0], (signs, n)


def test_base64_is_judged_as_before(coder):
    rng = random.Random(6)
    for n in (160, 256, 512, 1024, 4096, 20_000):
        noise = base64.b64encode(rng.randbytes(n))[:n]
        assert Q.wide_share(noise) == 0 and not Q.in_band(coder, noise)[0]
    assert Q.band(1024) == Q.band(1024, 0.0) and Q.band(100, 1.0) == (0.0, float("inf"))


def test_the_limit_moves_with_the_share_of_wide_signs():
    assert Q.wide_share(b"") == 0 and Q.wide_share("é".encode()) == 0 and Q.wide_share("水".encode()) == 1
    assert Q.wide_share("水abc".encode()) == 0.5
    lows = [Q.band(2048, share)[0] for share in (0.0, 0.1, 0.25, 0.5, 1.0)]
    assert lows == sorted(lows, reverse=True) and lows[3] == lows[4] == 1.50
    for n, *_ in Q.BANDS:
        assert Q.band(n, 1.0)[0] <= Q.band(n)[0]
