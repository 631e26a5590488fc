"""skeinlab.streaming"""
