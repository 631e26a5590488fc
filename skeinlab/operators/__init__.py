"""skeinlab.operators"""
