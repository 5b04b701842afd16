"""Published results of the model: numbers that its statistics and networks must give, as fixed values."""

# Unit root statistic and p, level statistic and p, lags used, observations, of twenty series of 258 days.
STATIONARITY = [
    (-14.61128861719996, 4.0189765893399924e-27, 0.11279301302460956, 0.1, 0, 257),
    (-13.54496086917037, 2.471720725661501e-25, 0.0722512374191591, 0.1, 0, 257),
    (-7.227731450229447, 2.0322536455860853e-10, 0.18030336025896232, 0.1, 6, 251),
    (-6.350091040260765, 2.62387261912843e-08, 0.06728529699249086, 0.1, 5, 252),
    (-8.124818471302248, 1.1305840329754242e-12, 0.10960594325899227, 0.1, 7, 250),
    (-8.26074891159192, 5.091303783962254e-13, 0.21685239528603606, 0.1, 6, 251),
    (-5.932219346479583, 2.365887794326327e-07, 0.13067205075873062, 0.1, 4, 253),
    (-7.900368903732076, 4.200969622201307e-12, 0.1117413534129139, 0.1, 5, 252),
    (-16.151781719973346, 4.5614535993712245e-29, 0.3087171294751395, 0.1, 0, 257),
    (-6.51734781588283, 1.0631714381409813e-08, 0.09962242174241545, 0.1, 11, 246),
    (-9.957069076051345, 2.4283159053569997e-17, 0.25623717255219214, 0.1, 1, 256),
    (-13.085827105032788, 1.830737700382465e-24, 0.2994998322076628, 0.1, 0, 257),
    (-9.13712064694634, 2.91539525439106e-15, 0.6974872193661218, 0.013773889148534382, 1, 256),
    (-13.5258409422165, 2.6796560182110747e-25, 0.2534976140161874, 0.1, 0, 257),
    (-8.890329233064131, 1.2475303835892692e-14, 1.5148929300151368, 0.01, 1, 256),
    (-6.523345757465912, 1.0290487196451578e-08, 0.34173285683601845, 0.1, 3, 254),
    (-7.400381316301556, 7.582642452842403e-11, 0.251235584352211, 0.1, 2, 255),
    (-4.330903678635231, 0.0003925470298706803, 0.21508860705944768, 0.1, 4, 253),
    (-3.9306182036063686, 0.001820719409154484, 1.2915947757927329, 0.01, 9, 248),
    (-3.93759063175275, 0.0017749736014133395, 0.2468122065822815, 0.1, 6, 251),
]

# Lag, observations, F, p, corrected p, Bonferroni p, edge weight of pairs of sectors; all ninety of a run.
GRANGER = [
    (1, 258, 0.0016032700306055489, 0.9680920096573526, 0.9770646495703006, 1.0, 0.010076699308112572),
    (2, 258, 0.22845680339655136, 0.7959259563606513, 0.9551111476327816, 1.0, 0.019946086013307145),
    (1, 258, 3.19168797342059, 0.07520615835366559, 0.4922592274917457, 1.0, 0.3078061341818471),
    (1, 258, 0.47427967073342475, 0.49165342191007877, 0.8148235476340284, 1.0, 0.08893642878852871),
    (1, 258, 0.07774154127768423, 0.7806085299011968, 0.9493887525825366, 1.0, 0.02255591767798569),
    (3, 258, 2.6051245374208234, 0.05239643773803204, 0.4922592274917457, 1.0, 0.3078061341818471),
    (1, 258, 0.12435281244644372, 0.724653079355556, 0.9316968163142862, 1.0, 0.030725388528992186),
    (1, 258, 0.04626554378877845, 0.8298664265006005, 0.9566195805643014, 1.0, 0.019260734018101525),
    (1, 258, 0.5895068026789795, 0.443323070980979, 0.7528127620431718, 1.0, 0.1233130271499445),
    (1, 258, 1.5451808858333436, 0.2149944951337889, 0.5725889383168951, 1.0, 0.2421570462451512),
    (1, 258, 2.41117216036639, 0.12171720818064868, 0.5216451779170658, 1.0, 0.28262480287731007),
    (1, 258, 1.6397896745989895, 0.20152242860833813, 0.5725889383168951, 1.0, 0.2421570462451512),
    (1, 258, 1.116996914466198, 0.2915701628285009, 0.6247932060610734, 1.0, 0.20426370157990506),
    (1, 258, 1.477517244390117, 0.22529195128719573, 0.5725889383168951, 1.0, 0.2421570462451512),
    (1, 258, 0.24398224456195608, 0.6217714770728194, 0.8668582146751971, 1.0, 0.06205193092022126),
    (1, 258, 2.806180643246968, 0.09513232131585589, 0.4922592274917457, 1.0, 0.3078061341818471),
    (1, 258, 0.781824770127041, 0.37741982944578345, 0.6939835774820023, 1.0, 0.15865080662487627),
    (1, 258, 0.32086461145756245, 0.5715886667310768, 0.864166188516012, 1.0, 0.06340272995742469),
    (2, 258, 2.8781184359904555, 0.058098686379846665, 0.4922592274917457, 1.0, 0.3078061341818471),
    (1, 258, 0.002305212096947903, 0.9617439113699254, 0.9770646495703006, 1.0, 0.010076699308112572),
    (1, 258, 0.24580800881657583, 0.6204710793825503, 0.8668582146751971, 1.0, 0.06205193092022126),
    (2, 258, 1.175209562918603, 0.31044727025817254, 0.6397151258126423, 1.0, 0.19401338043875613),
    (3, 258, 2.480542900048038, 0.06162592078194091, 0.4922592274917457, 1.0, 0.3078061341818471),
    (4, 258, 2.2296991545454086, 0.06640921399798512, 0.4922592274917457, 1.0, 0.3078061341818471),
    (5, 258, 1.8592786582596337, 0.1021524082381216, 0.4922592274917457, 1.0, 0.3078061341818471),
    (1, 258, 4.576072586642856, 0.033375094169019584, 0.42910835360168037, 1.0, 0.36743303082318796),
    (3, 258, 0.08876433328496224, 0.9661671707323221, 0.9770646495703006, 1.0, 0.010076699308112572),
    (1, 258, 0.032796111285166976, 0.8564358867078635, 0.9566195805643014, 1.0, 0.019260734018101525),
    (1, 258, 1.3214769586697035, 0.25140840823051663, 0.5730090437303742, 1.0, 0.24183852356279772),
    (1, 258, 0.16940034585199115, 0.6809923744822377, 0.9218308808918549, 1.0, 0.03534874731120707),
    (1, 258, 0.008271584130880843, 0.9276053926053129, 0.9770646495703006, 1.0, 0.010076699308112572),
    (3, 258, 3.46512814689147, 0.016910547358447672, 0.3804873155650726, 1.0, 0.41965981687479614),
    (1, 258, 0.007468065296538368, 0.9312022473402205, 0.9770646495703006, 1.0, 0.010076699308112572),
    (3, 258, 1.1433179249395986, 0.33218215664246425, 0.6643643132849285, 1.0, 0.1775937039745293),
    (1, 258, 1.0230904720389846, 0.3127496170639585, 0.6397151258126423, 1.0, 0.19401338043875613),
    (1, 258, 1.4888589885266197, 0.22352522740917805, 0.5725889383168951, 1.0, 0.2421570462451512),
    (1, 258, 0.16354711127722737, 0.6862518779972698, 0.9218308808918549, 1.0, 0.03534874731120707),
    (1, 258, 1.4253318867336389, 0.23364159295875414, 0.5725889383168951, 1.0, 0.2421570462451512),
    (2, 258, 1.9350280769004722, 0.14656855606641475, 0.5692620729735874, 1.0, 0.24468775004929857),
    (1, 258, 0.755546563974045, 0.38554643193444577, 0.6939835774820023, 1.0, 0.15865080662487627),
    (2, 258, 1.0346446794912587, 0.35686308825525986, 0.6833548498504975, 1.0, 0.1653537189943091),
    (3, 258, 1.0243393196817636, 0.3824249246283209, 0.6939835774820023, 1.0, 0.15865080662487627),
    (3, 258, 0.2356547717108251, 0.8714669419647265, 0.9566195805643014, 1.0, 0.019260734018101525),
    (2, 258, 0.6992007116369154, 0.49794772355412853, 0.8148235476340284, 1.0, 0.08893642878852871),
    (1, 258, 0.144871607073317, 0.7038033394078314, 0.9265810450857795, 1.0, 0.03311658833192553),
    (1, 258, 0.03226007507890124, 0.8576012476567376, 0.9566195805643014, 1.0, 0.019260734018101525),
    (1, 258, 0.0008281440707257169, 0.9770646495703006, 0.9770646495703006, 1.0, 0.010076699308112572),
    (3, 258, 0.6001648504916831, 0.6154575952124235, 0.8668582146751971, 1.0, 0.06205193092022126),
    (3, 258, 0.7368694967667195, 0.5309168634358787, 0.8382897843724402, 1.0, 0.07660582623984137),
    (2, 258, 1.8994001987837401, 0.1518032194596233, 0.5692620729735874, 1.0, 0.24468775004929857),
    (3, 258, 1.8214276470079693, 0.14376151248702465, 0.5692620729735874, 1.0, 0.24468775004929857),
    (5, 258, 1.5266984727980935, 0.182088847495351, 0.5725889383168951, 1.0, 0.2421570462451512),
    (1, 258, 4.595078358142632, 0.03301374674938672, 0.42910835360168037, 1.0, 0.36743303082318796),
    (1, 258, 1.6765783756723183, 0.1965554986026791, 0.5725889383168951, 1.0, 0.2421570462451512),
    (3, 258, 2.376258255502237, 0.07056008512373675, 0.4922592274917457, 1.0, 0.3078061341818471),
    (1, 258, 2.829575074549249, 0.093771759508031, 0.4922592274917457, 1.0, 0.3078061341818471),
    (4, 258, 1.3427138779379257, 0.2546706861023885, 0.5730090437303742, 1.0, 0.24183852356279772),
    (1, 258, 1.7950720125683968, 0.1815068291560504, 0.5725889383168951, 1.0, 0.2421570462451512),
    (3, 258, 1.3054440463039032, 0.2731915124856446, 0.599688685944098, 1.0, 0.2220741447229969),
    (3, 258, 0.6620416589505294, 0.576110792344008, 0.864166188516012, 1.0, 0.06340272995742469),
    (5, 258, 3.0535267543943556, 0.010814094718519546, 0.3804873155650726, 0.9732685246667592, 0.41965981687479614),
    (1, 258, 0.6196853311427443, 0.4318981547057074, 0.7475160369906475, 1.0, 0.12637948567666468),
    (1, 258, 0.1147982158189592, 0.7350261255363866, 0.9317232577221802, 1.0, 0.03071306349535873),
    (1, 258, 4.64906428864486, 0.03200958893723081, 0.42910835360168037, 1.0, 0.36743303082318796),
    (1, 258, 0.8799898939108293, 0.3490955842826352, 0.6830130996834167, 1.0, 0.1655709667933347),
    (5, 258, 0.4400293213857516, 0.8202958010328946, 0.9566195805643014, 1.0, 0.019260734018101525),
    (3, 258, 2.025808791903126, 0.110823965875598, 0.498707846440191, 1.0, 0.3021537987379833),
    (3, 258, 0.5839294753036262, 0.626064266154309, 0.8668582146751971, 1.0, 0.06205193092022126),
    (5, 258, 1.5486258955790244, 0.1754557131302842, 0.5725889383168951, 1.0, 0.2421570462451512),
    (5, 258, 2.8565867833404273, 0.015847936753831796, 0.3804873155650726, 1.0, 0.41965981687479614),
    (3, 258, 1.3668609417158304, 0.2534548261805213, 0.5730090437303742, 1.0, 0.24183852356279772),
    (5, 258, 1.5318412623000042, 0.18051353903953518, 0.5725889383168951, 1.0, 0.2421570462451512),
    (1, 258, 0.36161755367969073, 0.5481455587903659, 0.8505706946747056, 1.0, 0.07028958442508969),
    (1, 258, 0.016077410678859982, 0.8992016007251986, 0.9750378803044322, 1.0, 0.010978511596213778),
    (1, 258, 0.04378228241950445, 0.8344269169924752, 0.9566195805643014, 1.0, 0.019260734018101525),
    (1, 258, 0.13820818451627565, 0.710378801232431, 0.9265810450857795, 1.0, 0.03311658833192553),
    (2, 258, 2.2846671541940076, 0.10392139247047966, 0.4922592274917457, 1.0, 0.3078061341818471),
    (1, 258, 0.07884911576734119, 0.7790917429824152, 0.9493887525825366, 1.0, 0.02255591767798569),
    (1, 258, 0.10176663481158203, 0.7499820006086005, 0.9374775007607506, 1.0, 0.028039146440463774),
    (3, 258, 2.203997710248143, 0.08815676569467054, 0.4922592274917457, 1.0, 0.3078061341818471),
    (1, 258, 0.02618140154993113, 0.8715867289585857, 0.9566195805643014, 1.0, 0.019260734018101525),
    (1, 258, 1.4744741686449714, 0.22576883670474412, 0.5725889383168951, 1.0, 0.2421570462451512),
    (1, 258, 0.6576102604369808, 0.41816407099008845, 0.737936595864862, 1.0, 0.13198095152241562),
    (3, 258, 5.028587415040488, 0.0021174749772095653, 0.19057274794886087, 0.19057274794886087, 0.7199392037062272),
    (1, 258, 0.004481698341802109, 0.9466777650518631, 0.9770646495703006, 1.0, 0.010076699308112572),
    (1, 258, 1.4146437816945432, 0.2353976746413902, 0.5725889383168951, 1.0, 0.2421570462451512),
    (1, 258, 2.988846426472699, 0.08505498228852736, 0.4922592274917457, 1.0, 0.3078061341818471),
    (1, 258, 1.5993307044851215, 0.20715721114953786, 0.5725889383168951, 1.0, 0.2421570462451512),
    (5, 258, 0.7007618576119633, 0.6233617422019903, 0.8668582146751971, 1.0, 0.06205193092022126),
    (1, 258, 0.39824275579706503, 0.5285656137040209, 0.8382897843724402, 1.0, 0.07660582623984137),
]

# Correlation, observations, p of the best lags of pairs of sectors.
LEAD_LAG = [
    (0.14929786284674404, 246, 0.019136312426934404, True),
    (0.0878600600749397, 245, 0.17042269289908046, False),
    (-0.12128413072542515, 245, 0.058000746155414125, False),
    (0.07851492534341069, 250, 0.21604285017035968, False),
    (-0.10285752352010089, 249, 0.1054053314649716, False),
    (-0.16186870108579818, 248, 0.010677140139937067, True),
    (0.1134355517157091, 250, 0.07339474970761127, False),
    (-0.1471351011796064, 248, 0.020448790412662673, True),
    (-0.1290719310688192, 246, 0.04311736380724266, True),
    (0.08342852780520427, 250, 0.18857601550230427, False),
    (0.13883225652202272, 250, 0.028180166579166565, True),
    (0.17282734934315647, 250, 0.006151567237620382, True),
    (-0.11567802620659651, 249, 0.06840856734784627, False),
    (-0.13120208617722495, 248, 0.038954477156748275, True),
    (-0.13785558976633555, 248, 0.029979816190392732, True),
    (-0.14380964594276607, 249, 0.023227612124645653, True),
    (0.10249830519290856, 247, 0.1080651048007824, False),
    (-0.1692411000139715, 249, 0.00744008240274532, True),
    (-0.13997812541923726, 250, 0.026893261386471565, True),
    (-0.1255368411651639, 248, 0.0482922579521112, True),
    (0.06307859891854789, 249, 0.3215182661844283, False),
    (-0.08827905681886515, 245, 0.1683855490654547, False),
    (0.06988285803266059, 247, 0.27392767113717487, False),
    (0.08714043842975346, 248, 0.17132470442371295, False),
    (0.07274032267832847, 249, 0.2528049336908657, False),
    (-0.03609435361613909, 248, 0.5715792576367815, False),
    (0.16242731633454888, 248, 0.0104064987572318, True),
    (0.08630717957855549, 249, 0.17459505256782024, False),
    (-0.11697209577044956, 247, 0.066455182814409, False),
    (-0.04897063201748528, 246, 0.4444971025156244, False),
    (-0.13785929216475787, 248, 0.02997536151700633, True),
    (0.09947295158901259, 249, 0.11743195139433253, False),
    (-0.09068865074071893, 247, 0.15532143420377365, False),
    (-0.15322391160094515, 247, 0.01594655131431705, True),
    (-0.1246472731230952, 246, 0.050857444047965224, False),
    (-0.06310794625388541, 248, 0.32227626460714714, False),
    (-0.15880709277167052, 248, 0.012273776985649344, True),
    (-0.1763096255817999, 247, 0.005458229634227657, True),
    (-0.13110825467198184, 248, 0.03909572200019006, True),
    (-0.19823751338416049, 247, 0.0017428727401357909, True),
    (-0.11233493948293036, 248, 0.07744484846730776, False),
    (0.06277494925003488, 248, 0.32484126357621423, False),
    (-0.0937696603797867, 248, 0.14089346392748753, False),
    (-0.188422553921954, 247, 0.0029495599610072066, True),
    (-0.18153525196735434, 248, 0.0041275288520583086, True),
    (-0.08001392139493764, 246, 0.21108645829673212, False),
    (0.1678619352727751, 250, 0.007820381381999426, True),
    (-0.16700000329689607, 246, 0.008679986904731783, True),
    (-0.0727183257145966, 249, 0.2529488317120789, False),
    (-0.16119924623091647, 246, 0.011340915827547779, True),
    (-0.11707667934108874, 249, 0.06511158298861598, False),
    (-0.14300760616789587, 249, 0.024015590020068242, True),
    (-0.16976824563741796, 246, 0.007617997771038068, True),
    (-0.16372797765669744, 246, 0.010103258714707802, True),
    (-0.13860899973801272, 247, 0.029414618639141264, True),
    (-0.16523724219918762, 249, 0.008994554667703266, True),
    (0.17996982336385905, 245, 0.004718105946077743, True),
    (-0.13937145086663688, 246, 0.028852232510869817, True),
    (-0.18500251910758114, 249, 0.0033903302438862966, True),
    (-0.1556205502945019, 249, 0.013960044987364563, True),
    (0.0685304890000694, 248, 0.2823607123624786, False),
    (0.053316835442132976, 245, 0.40605060499397316, False),
    (-0.1150606374607536, 245, 0.07221682961033664, False),
    (0.11551987269638721, 249, 0.06878981133129723, False),
    (0.13866635743951, 250, 0.02837078764818213, True),
    (-0.16397607102872655, 245, 0.010142554395542389, True),
    (0.20148652693019486, 246, 0.0014894052972341148, True),
    (0.1329102084514742, 249, 0.036078398486827506, True),
    (0.1359121020277128, 248, 0.032397620502192075, True),
    (0.07074132229350431, 248, 0.2670859776898635, False),
    (0.08553699369838141, 246, 0.1811526921309168, False),
    (-0.13301141292884613, 249, 0.03593579940175735, True),
    (-0.1187529238864482, 245, 0.06347584928108876, False),
    (0.12128407018448459, 246, 0.05748616736599214, False),
    (-0.1605109120416081, 245, 0.011873616501889112, True),
    (-0.1440556676385116, 245, 0.024128841043199904, True),
    (0.2676751545423487, 246, 2.0920234300713376e-05, True),
    (0.116411707991781, 246, 0.06834143302336454, False),
    (-0.11073747500749875, 246, 0.083035591828608, False),
    (0.10084987717307856, 247, 0.11388407609184903, False),
    (0.11132953828635782, 249, 0.079539282553122, False),
    (-0.07212683538005939, 245, 0.26073509785303517, False),
    (-0.09191699272017097, 250, 0.1473037319452733, False),
    (0.1056147149459793, 249, 0.0963444396641082, False),
    (0.09787517822554935, 246, 0.12577641907281734, False),
    (0.07411086684276123, 249, 0.24395082631407064, False),
    (0.14057149349934803, 249, 0.02655180741312254, True),
    (0.1379633053462683, 246, 0.03052552192001008, True),
    (0.07666138685105252, 248, 0.22900085517675683, False),
    (0.0897773105855795, 248, 0.15868156128509547, False),
    (0.08144867702725617, 248, 0.20114371619238045, False),
    (-0.1118193195854501, 245, 0.08067542339968453, False),
    (-0.05701759990159451, 245, 0.3742043073183706, False),
    (0.11514834656296466, 250, 0.06912814987323213, False),
    (-0.033724136901684604, 245, 0.5993634258415698, False),
    (0.09711246637358732, 250, 0.12566819649210814, False),
    (0.13622343310393373, 245, 0.03306653462121514, True),
    (0.0808172429932398, 246, 0.2065244442598998, False),
    (0.08675984218904342, 249, 0.17233690078222896, False),
    (0.040171673979663924, 245, 0.5314309186857165, False),
]

# Edges of the raw network: source, target, p, weight.
EDGES = [
    ("Utilities", "SteelMaterials", 0.0021174749772095, 2.6741817131455656),
    ("Energy", "IndustrialLogistics", 0.0108140947185195, 1.9660098308441556),
    ("IndustrialLogistics", "Energy", 0.0158479367538317, 1.8000272706545615),
    ("Technology", "ConsumerDiscretionary", 0.0169105473584476, 1.7718423349861605),
    ("IndustrialLogistics", "Banking", 0.0320095889372308, 1.4947199029704774),
    ("ConsumerDiscretionary", "Healthcare", 0.0330137467493867, 1.4813051845383736),
    ("SteelMaterials", "Healthcare", 0.0333750941690195, 1.476577500248257),
]

# In-degree, out-degree, pagerank, betweenness, hub and authority scores of its nodes.
NODES = {
    "Banking": (1, 0, 0.1117264287136134, 0.0, -0.0, 2.2204460492503136e-16),
    "RealEstate": (0, 0, 0.051283619831929944, 0.0, -0.0, -0.0),
    "SteelMaterials": (1, 1, 0.09487461778620723, 0.013888888888888888, -6.13021295583827e-17, 1.0000000000000002),
    "Technology": (0, 1, 0.051283619831929944, 0.0, -1.8390113007628624e-16, -0.0),
    "ConsumerStaples": (0, 0, 0.051283619831929944, 0.0, -0.0, -0.0),
    "ConsumerDiscretionary": (1, 1, 0.09487461778620723, 0.013888888888888888, -6.149840582211767e-17, -2.7755575615628914e-16),
    "Energy": (1, 1, 0.12407231026535145, 0.0, 3.060809270336284e-17, 1.1102230246251564e-16),
    "IndustrialLogistics": (1, 2, 0.15674669125107496, 0.013888888888888888, 1.9884126041179891e-16, 4.1633363423443364e-17),
    "Healthcare": (2, 0, 0.21257085486982624, 0.0, -0.0, -1.1102230246251564e-16),
    "Utilities": (0, 1, 0.051283619831929944, 0.0, 1.0, -0.0),
}

# Correlations of the returns above the diagonal, in the order of the sectors; degree, sum and mean of |correlation| of each.
CORRELATIONS = [
    [0.22648848395006005, 0.4449425809928272, 0.5892042071735677, 0.5747488590596093, 0.5376125722312084, 0.30596960996717804, 0.4827382345643034, 0.2659624669682305, 0.40956802931412306],
    [0.2068809999994649, 0.12418418407482487, 0.28978063326131603, 0.37541483889566724, -0.018217972422169836, 0.22282079186827586, 0.05302640199505519, 0.17477856661101548],
    [0.40991137847142806, 0.5559036570891647, 0.5662096288419881, 0.14890355785448559, 0.5163553972995194, 0.2765599121807193, 0.4380162935813187],
    [0.4944697877729007, 0.4647047871981442, 0.3008417629746786, 0.5044238041076103, 0.3501931967431504, 0.39130277560422855],
    [0.5609478828339027, 0.25131507002314235, 0.498581573211194, 0.2944926573551737, 0.37491527254014717],
    [0.22566454648902246, 0.5410547525472623, 0.27576180400798594, 0.4822049730746363],
    [0.3402042358605723, 0.18453254940580766, 0.4640609587681939],
    [0.2992187054489494, 0.5834579480889714],
    [0.24477637528937063],
]
PRICE_NODES = {
    "Banking": (3, 1.7015656384643854, 0.4263594493579008),
    "RealEstate": (0, 0.0, 0.1879547636753166),
    "SteelMaterials": (3, 1.638468683230672, 0.3959648229234351),
    "Technology": (2, 1.093628011281178, 0.40324843156894813),
    "ConsumerStaples": (4, 2.1901819721938707, 0.43279504368295),
    "ConsumerDiscretionary": (4, 2.2058248364543616, 0.44773064290220194),
    "Energy": (0, 0.0, 0.24885669597391674),
    "IndustrialLogistics": (5, 2.6438734752545576, 0.44320616033296206),
    "Healthcare": (0, 0.0, 0.2493915632660492),
    "Utilities": (1, 0.5834579480889714, 0.3958979103191117),
}
PRICE_EDGES = [
    ("Banking", "Technology", 0.5892042071735677),
    ("IndustrialLogistics", "Utilities", 0.5834579480889714),
    ("Banking", "ConsumerStaples", 0.5747488590596093),
    ("SteelMaterials", "ConsumerDiscretionary", 0.5662096288419881),
    ("ConsumerStaples", "ConsumerDiscretionary", 0.5609478828339027),
    ("SteelMaterials", "ConsumerStaples", 0.5559036570891647),
    ("ConsumerDiscretionary", "IndustrialLogistics", 0.5410547525472623),
    ("Banking", "ConsumerDiscretionary", 0.5376125722312084),
    ("SteelMaterials", "IndustrialLogistics", 0.5163553972995194),
    ("Technology", "IndustrialLogistics", 0.5044238041076103),
    ("ConsumerStaples", "IndustrialLogistics", 0.498581573211194),
]

# Days, days with both, ratio of them.
COVERAGE = [
    (258, 0, 0.0, 258, 0.0, 258, 1.0),
    (258, 0, 0.0, 258, 0.0, 258, 1.0),
    (258, 0, 0.0, 257, 0.003875968992248062, 257, 0.9961240310077519),
    (258, 0, 0.0, 258, 0.0, 258, 1.0),
    (258, 0, 0.0, 258, 0.0, 258, 1.0),
    (258, 0, 0.0, 258, 0.0, 258, 1.0),
    (258, 0, 0.0, 258, 0.0, 258, 1.0),
    (258, 0, 0.0, 258, 0.0, 258, 1.0),
    (258, 0, 0.0, 216, 0.16279069767441862, 216, 0.8372093023255814),
    (258, 0, 0.0, 258, 0.0, 258, 1.0),
]
