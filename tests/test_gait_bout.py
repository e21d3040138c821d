"""The published example bout and its published results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracelode.operators import gait as G

# First stamp in ms, then (ms since, x, y, z) of each reading.
START = 1582654711262
BOUT = [
    (0, -0.7123260498046875, -0.039520263671875, -0.4839630126953125), (101, -0.8855438232421875, 0.0815887451171875, -0.5264434814453125), (201, -0.96484375, 0.104644775390625, -0.993438720703125),
    (301, -0.7404937744140625, -0.0535430908203125, -0.884521484375), (402, -0.6049652099609375, -0.030731201171875, -0.5730743408203125), (502, -0.5874176025390625, -0.1630706787109375, -0.428253173828125),
    (602, -0.7066192626953125, -0.074432373046875, -0.439056396484375), (703, -0.738311767578125, -0.036590576171875, -0.5035400390625), (803, -1.056884765625, 0.2378387451171875, -0.7693328857421875),
    (903, -0.5649566650390625, 0.1960296630859375, -1.1147613525390625), (1004, -0.7159271240234375, -0.0514373779296875, -0.64105224609375), (1104, -0.568634033203125, 0.071319580078125, -0.5269775390625),
    (1204, -0.7472686767578125, 0.2047882080078125, -0.5903778076171875), (1305, -0.6732025146484375, 0.175567626953125, -0.4357757568359375), (1405, -0.9683380126953124, 0.2735137939453125, -0.475555419921875),
    (1505, -0.872894287109375, -0.3148956298828125, -1.2193756103515625), (1606, -0.7633514404296875, 0.0699005126953125, -0.6373443603515625), (1706, -0.7039031982421875, -0.3090057373046875, -0.5151519775390625),
    (1806, -0.62701416015625, -0.37628173828125, -0.3398284912109375), (1907, -0.6988067626953125, -0.3836822509765625, -0.3662872314453125), (2007, -0.988067626953125, 0.321319580078125, -0.4259185791015625),
    (2107, -1.06787109375, 0.0805206298828125, -1.083404541015625), (2208, -0.8273773193359375, 0.0593109130859375, -1.1790771484375), (2308, -0.6784515380859375, -0.0675506591796875, -0.618621826171875),
    (2408, -0.4622802734375, 0.1671905517578125, -0.32623291015625), (2509, -0.6594085693359375, 0.2461700439453125, -0.3996734619140625), (2609, -0.8089752197265625, 0.140167236328125, -0.7128753662109375),
    (2709, -0.99700927734375, 0.1127777099609375, -0.7571563720703125), (2810, -0.91229248046875, -0.417144775390625, -1.483428955078125), (2910, -0.485565185546875, -0.0863037109375, -0.5752105712890625),
    (3010, -0.5167694091796875, -0.2926483154296875, -0.39776611328125), (3111, -0.6454010009765625, -0.3621063232421875, -0.357147216796875), (3211, -0.910186767578125, -0.1877899169921875, -0.833038330078125),
    (3311, -0.870849609375, 0.45257568359375, -1.199920654296875), (3412, -0.6144866943359375, -0.20697021484375, -0.8315277099609375), (3512, -0.665924072265625, -0.0334930419921875, -0.6830291748046875),
    (3612, -0.580841064453125, 0.1019134521484375, -0.4996795654296875), (3713, -0.7294769287109375, 0.1843414306640625, -0.5174713134765625), (3813, -0.971588134765625, -0.163421630859375, -0.9009246826171876),
    (3913, -0.748870849609375, -0.1918487548828125, -0.617645263671875), (4014, -0.80389404296875, -0.1419677734375, -0.8527069091796875), (4114, -0.537994384765625, -0.1656494140625, -0.536285400390625),
    (4214, -0.773590087890625, -0.1926116943359375, -0.5744781494140625), (4315, -0.7783355712890625, -0.232086181640625, -0.466522216796875), (4415, -0.8576812744140625, -0.1367950439453125, -0.5225677490234375),
    (4515, -0.941619873046875, -0.0161285400390625, -0.479400634765625), (4616, -1.0524139404296875, -0.207061767578125, -0.4900665283203125), (4716, -0.72821044921875, 0.48065185546875, -0.9059600830078124),
    (4816, -0.69219970703125, -0.12213134765625, -0.5819091796875), (4917, -0.7067413330078125, 0.2708282470703125, -0.5308837890625), (5017, -0.697021484375, 0.247039794921875, -0.4118499755859375),
    (5117, -0.830413818359375, 0.07965087890625, -0.526947021484375), (5218, -1.05633544921875, 0.039031982421875, -0.43585205078125), (5318, -0.8094635009765625, -0.091339111328125, -0.35882568359375),
    (5418, -0.9828643798828124, -0.360076904296875, -1.128662109375), (5519, -0.8217620849609375, -0.3204498291015625, -0.6300201416015625), (5619, -0.6316986083984375, -0.250213623046875, -0.304656982421875),
    (5719, -0.6846160888671875, -0.21148681640625, -0.30029296875), (5820, -1.0548248291015625, -0.0477294921875, -0.4666290283203125), (5920, -1.08056640625, 0.164093017578125, -1.1206512451171875),
    (6020, -0.6157684326171875, 0.1210784912109375, -1.743865966796875), (6121, -0.568634033203125, -0.03045654296875, -0.64288330078125), (6221, -0.2806396484375, 0.2041168212890625, -0.3799896240234375),
    (6321, -0.545989990234375, 0.299652099609375, -0.505584716796875), (6422, -0.6761474609375, -0.1636505126953125, -0.706939697265625), (6522, -0.961822509765625, 0.12646484375, -0.998779296875),
    (6622, -0.4258270263671875, -0.212493896484375, -0.638519287109375), (6723, -0.812347412109375, 0.14788818359375, -0.834228515625), (6823, -0.692657470703125, -0.1231536865234375, -0.5750732421875),
    (6923, -0.6765289306640625, 0.0106964111328125, -0.3851776123046875), (7024, -0.765869140625, 0.039794921875, -0.4671630859375), (7124, -1.1918487548828125, 0.4406585693359375, -0.7399139404296875),
    (7224, -0.810028076171875, -0.0269927978515625, -0.9467926025390624), (7325, -0.4345245361328125, 0.0258941650390625, -0.56353759765625), (7425, -0.511260986328125, 0.33941650390625, -0.421539306640625),
    (7525, -0.490142822265625, 0.479248046875, -0.612030029296875), (7626, -0.86456298828125, -0.0416259765625, -1.0801544189453125), (7726, -0.6648101806640625, 0.0813140869140625, -0.534942626953125),
    (7826, -0.734405517578125, 0.0613861083984375, -0.5969085693359375), (7927, -0.9508819580078124, 0.0156097412109375, -0.563232421875), (8027, -0.8889312744140625, -0.252197265625, -0.3681488037109375),
    (8127, -0.787078857421875, -0.248687744140625, -0.0980682373046875), (8228, -0.6537628173828125, -0.706939697265625, -0.6343994140625), (8328, -1.0140380859375, 0.0303802490234375, -1.3084564208984375),
    (8428, -0.747467041015625, 0.0386962890625, -0.41357421875), (8529, -0.721954345703125, -0.1464385986328125, -0.35467529296875), (8629, -0.643798828125, -0.309051513671875, -0.338653564453125),
    (8729, -1.1407623291015625, -0.5601806640625, -0.938232421875), (8830, -0.755035400390625, -0.2967987060546875, -0.534820556640625), (8930, -0.7479400634765625, -0.2788238525390625, -0.588470458984375),
    (9030, -0.7899322509765625, -0.3090362548828125, -0.4539794921875), (9131, -0.9513702392578124, -0.1615447998046875, -0.504150390625), (9231, -0.839691162109375, -0.0959930419921875, -0.326324462890625),
    (9331, -0.8098297119140625, 0.1104888916015625, -0.3697967529296875), (9432, -1.0455169677734375, 0.832489013671875, -0.9384918212890624), (9532, -0.5619964599609375, 0.5406036376953125, -0.5500335693359375),
    (9632, -0.4852447509765625, 0.5261688232421875, -0.693389892578125), (9733, -0.6914825439453125, 0.529296875, -0.596099853515625),
]
# Steps per second of the bout's ten seconds and its greatest power.
CADENCE = [1.65, 1.6, 1.55, 1.6, 1.55, 1.85, 1.8, 1.75, 1.75, 1.7]
POWER = 0.000482


def bout():
    t, x, y, z = (np.array(c, float) for c in zip(*BOUT, strict=True))
    return G.resample((t + START) / 1000, x, y, z)


def test_power_and_cadence():
    at, magnitude = bout()
    assert len(at) == 10 and len(magnitude) == 100
    power = G.rhythm_power(magnitude)
    assert power.shape == (80, 100) and abs(power.max() - POWER) < 1e-4
    assert np.round(G.cadence(magnitude), 2).tolist() == CADENCE


def test_whole_steps_by_hour(spark):
    rows = [("u", START + t, float(x), float(y), float(z)) for t, x, y, z in BOUT]
    seconds = G.walking_seconds(spark.createDataFrame(rows, "who string, t long, x double, y double, z double"), "who", F.col("t"))
    (hour,) = G.gait_bins(seconds, 3600, "America/New_York").collect()
    assert (hour.steps, hour.walking_time, round(hour.cadence, 2)) == (16, 10, 1.6)
    day = G.gait_report(seconds, 86_400).collect()
    assert len(day) == 1 and day[0].steps == 16 and abs(day[0].cadence - np.mean(CADENCE)) < 0.005
    assert G.gait_report(seconds, 3600).count() == 24


def test_long_signals_are_transformed_in_windows():
    t = np.arange(0, 900, 1 / G.FS)
    rng = np.random.default_rng(1)
    magnitude = 0.5 * np.sin(2 * np.pi * np.cumsum(np.repeat(rng.uniform(1.5, 2.2, 90), 100)) / G.FS)[: len(t)]
    windowed = G.rhythm_power(magnitude)
    whole = G.WINDOW
    try:
        G.WINDOW = len(t) * 2
        assert np.abs(G.rhythm_power(magnitude) - windowed).max() < 0.02 * windowed.max()
    finally:
        G.WINDOW = whole
