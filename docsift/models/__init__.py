"""Model stage: ONNX files as tables, executor-side sessions, detection geometry in numpy, greedy decoding."""
