"""Workload constants.

Fixed values (must equal the reference's for the same results):
  seed 30 for every random draw; train share 2/3 per class, 1/2 for custom data;
  shots 1 and 5, shot sweep 1 5 10 20; seen-fraction sweep 20 40 60 80 100;
  label-space sweep 10 to 100 percent in steps of 10; novel labels 50 (CLINC150),
  27 (BANKING77), 4 (ATIS), 33 percent (custom data); ATIS drops classes with
  fewer than 10 utterances; 2 negatives per positive; sequence length 64 for
  pairs and 48 for single sentences; vocabulary cap 50000; episodes 1000 with
  N=2, K=1, Q=20; 10 folds; 4 heads.
"""

SEED = 30
TRAIN_SHARE = (2, 3)
CUSTOM_TRAIN_SHARE = (1, 2)
SHOTS = (1, 5)
SHOT_SWEEP = (1, 5, 10, 20)
SEEN_FRACTION_SWEEP = (20, 40, 60, 80, 100)
LABEL_SPACE_SWEEP = (10, 20, 30, 40, 50, 60, 70, 80, 90, 100)
NOVEL_CLINC150 = 50
NOVEL_BANKING77 = 27
NOVEL_ATIS = 4
NOVEL_PERCENT_CUSTOM = 33
MIN_CLASS_ATIS = 10
NEGATIVE_RATIO = 2
PAIR_MAX_LEN = 64
SINGLE_MAX_LEN = 48
VOCAB_CAP = 50000
EPISODES, N_WAY, K_SHOT, Q_QUERY = 1000, 2, 1, 20
FOLDS = 10
HEADS = 4
